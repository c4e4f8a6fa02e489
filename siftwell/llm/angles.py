"""Hard negatives by angular triangle filtering.

Every row stores its length and its angles to a few reference directions. For an anchor and a
row the triangle inequality of angles turns these into an interval of the angle between
them, hence of the cosine and, multiplied by the lengths and widened against rounding, of the
integer score. The same holds for a block of rows with its smallest and largest
angles and lengths. Only blocks, then rows, whose interval reaches into a window that is still
open are scored, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.llm import arrays as ar

#: Reference directions, and rows they are chosen from, at most.
REFERENCES = 16
SAMPLE_ROWS = 2048
#: Rows of a block, and bytes of the anchors that are searched for at once.
BLOCK_ROWS = 2048
ANCHOR_BYTES = 1 << 24
# Slack of an angle and of a score against rounding, and what a double holds exactly.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
EXACT = float(1 << 52)
LONG = np.iinfo(np.int64)


def _vectors(column: pa.Array) -> np.ndarray:
    """Lists as rows of doubles, the shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _width(q: np.ndarray, dims: int) -> np.ndarray:
    return q if q.shape[1] >= dims else np.hstack([q, np.zeros((len(q), dims - q.shape[1]))])


def _angles(q: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to the references; a right angle where a vector has no direction."""
    dims = max(q.shape[1], references.shape[1])
    unit = _width(q, dims) / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(unit @ _width(references, dims).T, -1.0, 1.0))


def _spread_directions(q: np.ndarray, count: int) -> np.ndarray:
    """Unit rows far from each other: each next one has the smallest greatest cosine to those before."""
    norms = np.sqrt((q * q).sum(axis=1))
    unit = q[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.ones((1, 1))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        i = int(np.argmin(nearest))
        if nearest[i] > 1 - 1e-9:
            break
        chosen.append(i)
        nearest = np.maximum(nearest, unit @ unit[i])
    return unit[chosen]


def _bounds(at: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest) possible score of a vector with the angles ``at`` and the length ``size``
    with one whose angles lie in [low, high] and whose length in [least, most]; the last axis are references."""
    apart = np.maximum(np.maximum(low - at, at - high), 0.0).max(axis=-1) - ANGLE_SLACK
    first, last = at + low, at + high
    reach = np.where(last <= np.pi, last, np.where(first >= np.pi, 2 * np.pi - first, np.pi)).min(axis=-1) + ANGLE_SLACK
    upper, lower = np.cos(np.clip(apart, 0.0, np.pi)), np.cos(np.clip(reach, 0.0, np.pi))
    slack = SCORE_SLACK * size * most + 1.0
    return np.where(lower >= 0, lower * least, lower * most) * size - slack, np.where(upper >= 0, upper * most, upper * least) * size + slack


def _scores(q: np.ndarray, norms: np.ndarray, anchor: np.ndarray, size: float) -> np.ndarray:
    """Exact integer products; doubles hold them while the lengths say so, else Python's integers."""
    dims = max(q.shape[1], len(anchor))
    q, anchor = _width(q, dims), np.append(anchor, np.zeros(dims - len(anchor)))
    if size * norms.max(initial=0.0) < EXACT:
        return (q @ anchor).astype(np.int64)
    a = [int(x) for x in anchor]
    found = [sum(int(x) * y for x, y in zip(row, a)) for row in q]
    return np.array([min(max(x, LONG.min), LONG.max) for x in found], np.int64)


class _Best:
    """The first ``k`` (score downwards, id upwards) that were offered, with the score that a further one needs."""

    def __init__(self, k: int):
        self.k, self.need = k, None
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.need is not None:
            fit = scores >= self.need
            scores, ids = scores[fit], ids[fit]
        if not len(scores):
            return
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, ~scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.need = int(self.scores[-1])


def describe(rows: DataFrame, scale: int, references: int = REFERENCES) -> DataFrame:
    """(vec_id, label, q, norm, angles) of the rows that take part, as a table sorted into blocks of like rows."""
    usable = rows.filter("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    some = usable.withColumn("h", F.xxhash64("vec_id", F.lit(23))).orderBy("h", "vec_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    q = np.floor(scale * _vectors(some["embedding"])) if some.num_rows else np.zeros((0, 1))
    fixed = _spread_directions(q[np.isfinite(q).all(axis=1)], references)
    kind = dict(usable.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                raw = _vectors(part.column("embedding"))
                fine = np.isfinite(raw).all(axis=1)  # a null component is not a number here
                part, q = part.filter(pa.array(fine)), np.floor(scale * raw[fine])
                norms = np.sqrt((q * q).sum(axis=1))
                angles = _angles(q, norms, fixed)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64())) for x in (q, angles)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), lists[0], pa.array(norms), lists[1], pa.array(angles.argmin(axis=1).astype(np.int32))],
                    ["vec_id", "label", "q", "norm", "angles", "cell"])

    out = usable.mapInArrow(ar.tidy(run), f"vec_id long, label {kind}, q array<double>, norm double, angles array<double>, cell int")
    out = runtime.write_scratch(out, "described")
    # By ranges that vec_id ends, so that a label or a direction with a large share of the rows is spread.
    return runtime.write_scratch(out.repartitionByRange("label", "cell", "vec_id").sortWithinPartitions("label", "cell", "vec_id"), "blocks")


class _Rows:
    """A block of rows with the limits of its angles and lengths."""

    def __init__(self, batch: pa.RecordBatch, names: dict):
        self.ids = batch.column("vec_id").to_numpy()
        self.labels = np.array([names.setdefault(x, len(names)) for x in batch.column("label").to_pylist()])
        self.q, self.angles = _vectors(batch.column("q")), _vectors(batch.column("angles"))
        self.norms = batch.column("norm").to_numpy()
        self.present = set(self.labels.tolist())
        self.limits = self.angles.min(axis=0), self.angles.max(axis=0), self.norms.min(), self.norms.max()


class _Anchors:
    """A bounded block of anchors."""

    def __init__(self, table: pa.Table):
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_pylist()
        self.q, self.angles = _vectors(table["q"]), _vectors(table["angles"])
        self.norms = table["norm"].to_numpy()

    def reach(self, block: _Rows) -> tuple[np.ndarray, np.ndarray]:
        low, high, least, most = block.limits
        return _bounds(self.angles, self.norms, low, high, least, most)

    def rows(self, i: int, block: _Rows, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angles, norms = block.angles[rows], block.norms[rows]
        return _bounds(self.angles[i], self.norms[i], angles, angles, norms, norms)

    def score(self, i: int, block: _Rows, rows: np.ndarray) -> np.ndarray:
        return _scores(block.q[rows], block.norms[rows], self.q[i], self.norms[i])


def _blocks(batches: Iterator[pa.RecordBatch], names: dict) -> Iterator[_Rows]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            yield _Rows(batch.slice(lo, BLOCK_ROWS), names)


def _windows(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), high * score // 100


def _positives(anchors: _Anchors, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        labels = [names.setdefault(x, len(names)) for x in anchors.labels]
        best = [_Best(k) for _ in anchors.ids]
        scored = 0
        for block in _blocks(batches, names):
            _, upper = anchors.reach(block)
            for i, label in enumerate(labels):
                need = best[i].need
                if label not in block.present or need is not None and upper[i] < need:
                    continue
                rows = np.flatnonzero((block.labels == label) & (block.ids != anchors.ids[i]))
                if need is not None:
                    rows = rows[anchors.rows(i, block, rows)[1] >= need]
                if len(rows):
                    scored += len(rows)
                    best[i].offer(anchors.score(i, block, rows), block.ids[rows])
        n = [len(b.ids) for b in best]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(best)), n).astype(np.int32)), pa.array(np.concatenate([b.ids for b in best] or [np.zeros(0, np.int64)])),
            pa.array(np.concatenate([b.scores for b in best] or [np.zeros(0, np.int64)])), pa.array(np.full(sum(n), scored, np.int64))],
            ["anchor", "positive_id", "positive_score", "scored"])

    return run


def _negatives(anchors: _Anchors, wanted: list[list[tuple[int, int, int, int]]], k: int):
    """wanted: for each anchor (place of the positive, its id, smallest, largest score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        labels = [names.setdefault(x, len(names)) for x in anchors.labels]
        best = [[_Best(k) for _ in w] for w in wanted]
        scored = 0
        for block in _blocks(batches, names):
            lower, upper = anchors.reach(block)
            for i, label in enumerate(labels):
                if block.present == {label}:
                    continue
                # What each window still takes: from its k-th score so far, or its lower end, to its upper end.
                still = [(max(lo, b.need if b.need is not None else lo), hi, b) for (_, _, lo, hi), b in zip(wanted[i], best[i])]
                still = [(lo, hi, b) for lo, hi, b in still if lo <= hi and lower[i] <= hi and upper[i] >= lo]
                if not still:
                    continue
                rows = np.flatnonzero((block.labels != label) & (block.ids != anchors.ids[i]))
                least, most = anchors.rows(i, block, rows)
                rows = rows[reduce(np.logical_or, [(least <= hi) & (most >= lo) for lo, hi, _ in still])]
                if len(rows):
                    scored += len(rows)
                    scores, ids = anchors.score(i, block, rows), block.ids[rows]
                    for lo, hi, b in still:
                        fit = (scores >= lo) & (scores <= hi)
                        b.offer(scores[fit], ids[fit])
        flat = [(i, w[0], b) for i, (own, found) in enumerate(zip(wanted, best)) for w, b in zip(own, found)]
        n = [len(b.ids) for _, _, b in flat]
        yield pa.RecordBatch.from_arrays([
            *[pa.array(np.repeat(np.array([x[c] for x in flat], np.int32), n)) for c in (0, 1)],
            pa.array(np.concatenate([b.ids for _, _, b in flat] or [np.zeros(0, np.int64)])),
            pa.array(np.concatenate([b.scores for _, _, b in flat] or [np.zeros(0, np.int64)])), pa.array(np.full(sum(n), scored, np.int64))],
            ["anchor", "place", "negative_id", "negative_score", "scored"])

    return run


def _first(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(index: DataFrame, anchors: _Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = index.sparkSession
    scan = runtime.limit_tasks(index)
    found = scan.mapInArrow(ar.tidy(_positives(anchors, positives)), "anchor int, positive_id long, positive_score long, scored long")
    near = _first(found, ["anchor"], "positive_score", "positive_id", positives).select("anchor", F.col("rank").alias("place"), "positive_id", "positive_score")
    near = runtime.write_scratch(near, "positives")
    wanted: list[list[tuple[int, int, int, int]]] = [[] for _ in anchors.ids]
    for r in sorted(near.collect()):  # so many rows as an anchor has positives, for the anchors of one block
        wanted[r["anchor"]].append((r["place"], r["positive_id"], *_windows(r["positive_score"], low, high)))
    found = scan.mapInArrow(ar.tidy(_negatives(anchors, wanted, negatives)), "anchor int, place int, negative_id long, negative_score long, scored long")
    best = _first(found, ["anchor", "place"], "negative_score", "negative_id", negatives)
    named = spark.createDataFrame([(i, int(x)) for i, x in enumerate(anchors.ids)], "anchor int, anchor_id long")
    pairs = F.broadcast(near.join(F.broadcast(named), "anchor"))
    return best.join(pairs, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` selects.

    rows: ``vec_id``, ``label``, ``embedding``; other columns are ignored. A component x counts as floor(scale * x),
    a score is the product of two such vectors in whole numbers; higher first, equal ones by vec_id. An
    anchor's positives are its first ``positives`` other rows of its label; for each, the first
    ``negatives`` rows of other labels with low % to high % of its score are returned.

    Rows without a vec_id, label or vector, or with a null or non-finite component, take no part. A shorter
    vector counts as filled up with zeros, an empty one as zero. Rows that repeat a vec_id are rows of
    their own, but none is "other" to an anchor of that id; equal anchor rows are answered once. Scores
    beyond 64 bits are returned as the nearest 64-bit value. An empty table gives an empty result.

    Anchors are searched for in blocks of at most ANCHOR_BYTES; every block is two scans of the described
    rows, each of which returns a few rows for an anchor and task.
    """
    spark = rows.sparkSession
    runtime.ship_package(spark)
    index = describe(rows, scale)
    chosen = index.filter(anchor).select("vec_id", "label", "q", "norm", "angles").dropDuplicates(["vec_id", "label", "q"])
    size = chosen.agg(F.count("*").alias("n"), F.sum(8 * (F.size("q") + F.size("angles") + 4)).alias("b")).first()
    blocks = -(-(size["b"] or 0) // ANCHOR_BYTES) or 1
    parts = []
    for k in range(blocks):
        part = chosen.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)) == k).toArrow()
        if part.num_rows:
            parts.append(_search(index, _Anchors(part.sort_by("vec_id")), positives, negatives, low, high))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, parts)
