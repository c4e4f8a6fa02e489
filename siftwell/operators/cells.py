"""Vectors in cells with residual codes: approximate search, and exact search that leaves cells out.

``save_cells`` puts every vector into the cell of its nearest centre, and a vector near a
border into the next cell as well. Beside the vector lie its distance from the centre and a
short code of what the centre leaves of it. Approximate search reads the codes
of the probed cells, a fraction of the vectors' bytes, and ranks only the most promising
vectors exactly. Exact search reads cells from the nearest on; the triangle inequality
says which cells, and which rows of a cell, cannot hold one of the k nearest.

The number of cells grows with the square root of the table, so what a query reads does
so too; centres and codes are fitted on bounded samples, but every vector is stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import scoring as sc
from siftwell.operators import dense, topk
from siftwell.operators.batch import QueryBatch
from siftwell.schema import NEIGHBOURS

#: Bounds of the fitted parts: cells, vectors that the codes are fitted on, values of a code's byte.
MAX_CELLS = 16384
SAMPLE_ROWS = 16384
MAX_CODES = 256
#: Dimensions that share a byte of the code, rows of the sample for each of its values, rounds of fitting.
WIDTH, ROWS_PER_CODE, ROUNDS = 4, 8, 10
#: A vector is near a border if the second centre is at most this much farther than the first.
BORDER = 1.3
# Slack of a distance on the sphere against rounding, and of a cosine distance that ranks rounded.
SLACK, RANK_SLACK = 1e-6, 2e-9
#: Rows that are decoded at a time.
STEP = 4096


@dataclass(frozen=True)
class CellIndex:
    """``table``: ``cell, doc_id, second, apart, code, embedding``."""

    table: DataFrame
    centres: np.ndarray      # cells x dimensions
    books: list[np.ndarray]  # for each group of dimensions: values x its dimensions
    radii: np.ndarray        # largest distance of a first-choice row from its centre, -1 for none
    sizes: np.ndarray        # first-choice rows

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def n_vectors(self) -> int:
        return int(self.sizes.sum())


def cells_for(n_vectors: int) -> int:
    return max(1, min(MAX_CELLS, round(math.sqrt(n_vectors))))


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(axis=1), 0.0)


def _on_sphere(cosine_distance: float) -> float:
    """The distance between unit vectors of at most this cosine distance, as it is rounded for ranking."""
    return math.sqrt(2.0 * (max(cosine_distance, 0.0) + RANK_SLACK))


def _groups(dims: int) -> list[slice]:
    return [slice(i, min(i + WIDTH, dims)) for i in range(0, dims, WIDTH)]


def _fit_book(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` typical rows of ``x`` by the usual alternation of assigning and averaging."""
    book = x[np.random.default_rng(seed).permutation(len(x))[:n]].copy()
    for _ in range(ROUNDS):
        nearest = _squared(x, book).argmin(axis=1)
        total = np.zeros_like(book)
        np.add.at(total, nearest, x)
        count = np.bincount(nearest, minlength=len(book))
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def _encode(residual: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.stack([_squared(residual[:, g], b).argmin(axis=1).astype(np.uint8) for g, b in zip(_groups(residual.shape[1]), books)], axis=1)


def _decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.hstack([b[codes[:, i]] for i, b in enumerate(books)])


def _binary(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as one binary value a row."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _codes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _placed(centres: np.ndarray, books: list[np.ndarray]) -> Callable:
    """Rows of the table for batches of (doc_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                batch = whole.slice(lo, STEP)
                unit, usable = dense._unit_rows(dense._matrix(batch.column("embedding")))
                unit, batch = unit[usable], batch.filter(pa.array(usable))
                if not len(unit):
                    continue
                gap = np.sqrt(_squared(unit, centres))
                order = np.argsort(gap, axis=1, kind="stable")[:, :2]
                for nth in range(order.shape[1]):
                    cell = order[:, nth]
                    apart = gap[np.arange(len(gap)), cell]
                    here = np.ones(len(unit), bool) if nth == 0 else apart <= BORDER * gap[np.arange(len(gap)), order[:, 0]]
                    part = batch.filter(pa.array(here))
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id"), pa.array(np.full(len(part), nth > 0)), pa.array(apart[here]),
                        _binary(_encode(unit[here] - centres[cell[here]], books)), part.column("embedding"), pa.array(cell[here].astype(np.int32)),
                    ], ["doc_id", "second", "apart", "code", "embedding", "cell"])

    return run


def save_cells(vectors: DataFrame, path: str, n_cells: int | None = None, seed: int = 7) -> CellIndex:
    """Fit centres and codes to ``doc_id, embedding``, write every usable vector below ``path``, open it.

    The vectors' median dimension counts; vectors of another one, and those of length zero,
    have no place among them and are left out, as in exact search.
    """
    spark = vectors.sparkSession
    known = vectors.filter(F.col("embedding").isNotNull()).select("doc_id", "embedding")
    dims = known.agg(F.percentile_approx(F.size("embedding"), 0.5)).first()[0] or 1
    known = known.filter(F.size("embedding") == dims)
    n = known.count()
    some = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(SAMPLE_ROWS).select("embedding").toArrow()
    sample, usable = dense._unit_rows(dense._matrix(some["embedding"].combine_chunks())) if some.num_rows else (np.zeros((0, dims)), np.zeros(0, bool))
    sample = sample[usable]
    if len(sample):
        wanted = min(n_cells or cells_for(n), len(sample))
        centres = sample.mean(axis=0)[None, :] if wanted == 1 else np.array(dense.train_cells(known, wanted, seed=seed).clusterCenters())
        residual = sample - centres[_squared(sample, centres).argmin(axis=1)]
        n_codes = max(1, min(MAX_CODES, len(sample) // ROWS_PER_CODE))
        books = [_fit_book(residual[:, g], n_codes, seed) for g in _groups(dims)]
    else:
        centres, books = np.zeros((1, dims)), [np.zeros((1, g.stop - g.start)) for g in _groups(dims)]
    kind = "doc_id long, second boolean, apart double, code binary, embedding array<float>, cell int"
    rows = known.mapInArrow(_placed(centres, books), kind)
    # Small cells are gathered; one with a large share of all vectors is split over files.
    rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    fitted = [(0, i, c.tolist()) for i, c in enumerate(centres)] + [(1 + g, i, v.tolist()) for g, b in enumerate(books) for i, v in enumerate(b)]
    spark.createDataFrame(fitted, "part int, place int, value array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted")
    table = spark.read.schema(kind).parquet(f"{path}/rows")
    table.filter("not second").groupBy("cell").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/limits")
    return load_cells(spark, path)


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    fitted = sorted(map(tuple, spark.read.parquet(f"{path}/fitted").collect()))
    parts = [np.array([v for p, _, v in fitted if p == k]) for k in range(fitted[-1][0] + 1)]
    radii, sizes = np.full(len(parts[0]), -1.0), np.zeros(len(parts[0]), np.int64)
    for r in spark.read.parquet(f"{path}/limits").collect():  # one row a cell, MAX_CELLS at most
        radii[r["cell"]], sizes[r["cell"]] = r["radius"], r["n"]
    kind = "doc_id long, second boolean, apart double, code binary, embedding array<float>, cell int"
    return CellIndex(spark.read.schema(kind).parquet(f"{path}/rows"), parts[0], parts[1:], radii, sizes)


# -- queries in bounded blocks -------------------------------------------------


def _query_blocks(batch: QueryBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of the usable queries, in blocks that fit the broadcast limit."""
    size = batch.n_queries * dims * 8
    blocks = max(1, math.ceil(size / batch.broadcast_bytes))
    rows = batch.queries.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).select("query_id", "embedding")
    for i in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("query_id", F.lit(11)), F.lit(blocks)) == i)
        table = part.toArrow().combine_chunks()
        if table.num_rows:
            unit, usable = dense._unit_rows(dense._matrix(table["embedding"].combine_chunks()))
            yield table["query_id"].to_numpy()[usable], unit[usable]


def _union(parts: list[DataFrame], spark: SparkSession, kind) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)


def _in_cells(index: CellIndex, members: dict[int, np.ndarray]) -> DataFrame:
    """Rows of the cells that some query wants; at most MAX_CELLS values prune the folders."""
    return index.table.filter(F.col("cell").isin([int(c) for c in members]))


def _by_cell(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    cells = batch.column("cell").to_numpy()
    for c in np.unique(cells):
        yield int(c), batch.filter(pa.array(cells == c))


# -- approximate ---------------------------------------------------------------


def _promising(index: CellIndex, ids: np.ndarray, queries: np.ndarray, n_probe: int, rerank: int) -> DataFrame:
    """``query_id, doc_id``: the ``rerank`` nearest by code among the rows of the probed cells."""
    gap = _squared(queries, index.centres)
    gap[:, index.sizes == 0] = np.inf
    probes = np.argsort(gap, axis=1, kind="stable")[:, :n_probe]
    members = {int(c): np.nonzero((probes == c).any(axis=1))[0] for c in np.unique(probes)}
    spark = index.table.sparkSession
    shared = spark.sparkContext.broadcast((ids, queries, members, index.centres, index.books))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, members, centres, books = shared.value
        best = dense._BestRows(ids, rerank)
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                for cell, rows in _by_cell(whole.slice(lo, STEP)):
                    near = centres[cell] + _decode(_codes(rows.column("code"), len(books)), books)
                    dense._offer_blocks(best, members[cell], queries, rows.column("doc_id").to_numpy(), near)
        yield best.batch()

    rows = runtime.limit_tasks(_in_cells(index, members).select("doc_id", "code", "cell"))
    found = rows.mapInArrow(scan, NEIGHBOURS)
    once = found.groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance"))  # border vectors lie in two cells
    return topk.top_k(once, rerank, "distance", descending=False).select("query_id", "doc_id")


def _ranked_exactly(index: CellIndex, pairs: DataFrame, batch: QueryBatch, ids: np.ndarray, queries: np.ndarray, rerank: int) -> DataFrame:
    """``query_id, doc_id, distance`` of given pairs, from the vectors themselves."""
    order = np.argsort(ids)
    shared = pairs.sparkSession.sparkContext.broadcast((ids[order], queries[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        for b in batches:
            unit, usable = dense._unit_rows(dense._matrix(b.column("embedding")))
            own = queries[np.searchsorted(ids, b.column("query_id").to_numpy())]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("doc_id"), pa.array(1.0 - (unit * own).sum(axis=1))], schema=dense._OUT)

    side = batch.per_query(pairs, rerank, 16)
    joined = index.table.filter("not second").select("doc_id", "embedding").join(side, "doc_id")
    return joined.select("query_id", "doc_id", "embedding").mapInArrow(score, NEIGHBOURS)


def _probe(index: CellIndex, k: int, n_probe: int | None, rerank: int | None) -> tuple[int, int]:
    n_probe = min(n_probe or max(1, -(-len(index.centres) // 2)), len(index.centres))
    return n_probe, max(k, rerank or 10 * k)


def approximate_topk(index: CellIndex, batch: QueryBatch, k: int = 10, n_probe: int | None = None, rerank: int | None = None) -> DataFrame:
    """Approximate nearest documents: ``query_id, doc_id, distance, similarity, rank``.

    ``n_probe`` cells are searched by code (half of the cells where not given), and the ``rerank`` most
    promising vectors (ten for each result) are ranked by their true distance.
    """
    n_probe, rerank = _probe(index, k, n_probe, rerank)
    parts = []
    for ids, queries in _query_blocks(batch, index.dims):
        if len(ids):
            pairs = _promising(index, ids, queries, n_probe, rerank)
            parts.append(_ranked_exactly(index, pairs, batch, ids, queries, rerank))
    found = topk.top_k(_union(parts, index.table.sparkSession, NEIGHBOURS), k, "distance", descending=False)
    return found.withColumn("similarity", sc.similarity(F.col("distance")))


def ranked_counts(index: CellIndex, batch: QueryBatch, k: int = 10, n_probe: int | None = None, rerank: int | None = None) -> DataFrame:
    """``query_id, n_exact``: how many vectors ``approximate_topk`` ranks by their true distance."""
    n_probe, rerank = _probe(index, k, n_probe, rerank)
    parts = [_promising(index, ids, queries, n_probe, rerank) for ids, queries in _query_blocks(batch, index.dims) if len(ids)]
    pairs = _union(parts, index.table.sparkSession, "query_id long, doc_id long")
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"))


# -- exact, with cells left out --------------------------------------------------


@dataclass(frozen=True)
class PrunedSearch:
    """``results`` as of exact search, ``reads``: ``query_id, n_cells, n_rows``, what was read and scored."""

    results: DataFrame
    reads: DataFrame


def _scored(index: CellIndex, ids: np.ndarray, queries: np.ndarray, wanted: np.ndarray, limits: np.ndarray, k: int) -> DataFrame:
    """``query_id, doc_id, distance`` of the k best first-choice rows of the wanted (query x cell), and one
    row a task and query without a doc_id that counts the rows that were scored in ``distance``."""
    members = {int(c): np.nonzero(wanted[:, c])[0] for c in np.flatnonzero(wanted.any(axis=0))}
    gap = np.sqrt(_squared(queries, index.centres))
    shared = index.table.sparkSession.sparkContext.broadcast((ids, queries, members, gap, limits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, members, gap, limits = shared.value
        best, count = dense._BestRows(ids, k), np.zeros(len(ids))
        for whole in batches:
            for lo in range(0, whole.num_rows, STEP):
                for cell, rows in _by_cell(whole.slice(lo, STEP)):
                    apart, doc_ids = rows.column("apart").to_numpy(), rows.column("doc_id").to_numpy()
                    unit, _ = dense._unit_rows(dense._matrix(rows.column("embedding")))
                    for q in members[cell]:
                        # The k-th distance so far, on the sphere, bounds what the row's distance from the centre may be.
                        limit = min(limits[q], _on_sphere(best.limit[q])) + SLACK
                        near = np.flatnonzero(np.abs(gap[q, cell] - apart) <= limit)
                        if len(near):
                            count[q] += len(near)
                            dense._offer_blocks(best, np.array([q]), queries, doc_ids[near], unit[near])
        yield best.batch()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(count)], ["query_id", "doc_id", "distance"])

    rows = _in_cells(index, members).filter("not second").select("doc_id", "apart", "embedding", "cell")
    return runtime.limit_tasks(rows).mapInArrow(scan, "query_id long, doc_id long, distance double")


def _pruned_block(index: CellIndex, ids: np.ndarray, queries: np.ndarray, k: int, first: int) -> tuple[DataFrame, DataFrame]:
    spark = index.table.sparkSession
    gap = np.sqrt(_squared(queries, index.centres))
    gap[:, index.sizes == 0] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")
    # The nearest cells, and so many more as hold k rows.
    filled = np.cumsum(index.sizes[order], axis=1) >= k
    n_first = np.where(filled.any(axis=1), np.maximum(filled.argmax(axis=1) + 1, first), len(index.centres))
    near = np.zeros(gap.shape, bool)
    np.put_along_axis(near, order, np.arange(gap.shape[1])[None, :] < n_first[:, None], axis=1)
    near &= index.sizes > 0
    one = runtime.write_scratch(_scored(index, ids, queries, near, np.full(len(ids), np.inf), k), "nearest-cells")
    kth = topk.top_k(one.filter("doc_id is not null"), k, "distance", descending=False).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("kth")
    )
    limits = np.full(len(ids), np.inf)
    place = {int(q): i for i, q in enumerate(ids)}
    for r in kth.filter("kth is not null").collect():  # one row a query of the block
        limits[place[r["query_id"]]] = _on_sphere(r["kth"])
    # No row of a cell is nearer than the centre's distance less the radius.
    further = (np.where(np.isfinite(gap), gap, np.inf) - index.radii <= limits[:, None] + SLACK) & ~near & (index.sizes > 0)
    two = runtime.write_scratch(_scored(index, ids, queries, further, limits, k), "further-cells")
    both = one.unionByName(two)
    n_cells = spark.createDataFrame([(int(q), int(n)) for q, n in zip(ids, (near | further).sum(axis=1))], "query_id long, n_cells long")
    rows = both.filter("doc_id is null").groupBy("query_id").agg(F.sum("distance").cast("long").alias("n_rows"))
    return both.filter("doc_id is not null"), n_cells.join(rows, "query_id", "left").select("query_id", "n_cells", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def pruned_search(index: CellIndex, batch: QueryBatch, k: int = 10, first: int = 2) -> PrunedSearch:
    """Exact nearest documents from the cells that can hold them: the ``first`` nearest cells give a
    distance, then every cell is read that the triangle inequality does not rule out."""
    spark = index.table.sparkSession
    parts = [_pruned_block(index, ids, queries, k, first) for ids, queries in _query_blocks(batch, index.dims) if len(ids)]
    found = topk.top_k(_union([p for p, _ in parts], spark, NEIGHBOURS), k, "distance", descending=False)
    reads = _union([r for _, r in parts], spark, "query_id long, n_cells long, n_rows long")
    return PrunedSearch(found.withColumn("similarity", sc.similarity(F.col("distance"))), reads)
