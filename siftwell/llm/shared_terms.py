"""Ranked lexical search for many items at once, their common subexpressions evaluated once.

An item's score for a document is the sum of the parts of its terms. Pairs of terms, and of
sums found before, that several items hold are mined round by round and become nodes
of a graph: every node is the sum of two others, and items that share a node share its
accumulators. For a slice of documents the accumulators of all nodes are made level by
level, once each, and every item adds up the few nodes that are left of it. All numbers are
whole, so neither sharing nor order changes a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siftwell import runtime
from siftwell.llm import arrays as ar

#: Items and entries of (item, term) of a block that is evaluated at once.
BLOCK_ITEMS, BLOCK_ENTRIES = 1024, 32768
#: Symbols of an item, in order of frequency, that a symbol is paired with.
PAIRED = 24
#: Accumulators that a task holds at a time.
HELD = 1 << 22
# Fixed values of the score.
WEIGHT, GAIN, TF_STEP, LENGTH_STEP, LENGTH_LEAST, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 8, 10, 90

#: Bytes of a term: digits, letters and all that is not ASCII.
MEMBER = np.zeros(256, bool)
MEMBER[48:58] = MEMBER[65:91] = MEMBER[97:123] = MEMBER[128:] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by row) of the terms of a slice of texts."""
    starts, ends = ar.spans(MEMBER[data], offsets)
    return ar.span_hashes(ar.LOWER[data], starts, ends), np.searchsorted(starts, offsets)


@dataclass(frozen=True)
class Sharing:
    """The graph of a block: symbols below ``n_terms`` are terms, symbol n_terms + i is left[i] + right[i]."""

    n_terms: int
    left: np.ndarray
    right: np.ndarray
    levels: list[np.ndarray]      # symbols by depth, each made of symbols of lesser depth
    symbols: np.ndarray           # what is left of the items, one after the other
    starts: np.ndarray            # where an item's symbols start

    def additions(self) -> int:
        """Accumulators that are added for a document."""
        return len(self.left) + len(self.symbols) - len(self.starts)

    def totals(self, parts: np.ndarray) -> np.ndarray:
        """Scores (items x documents) from the parts (terms x documents)."""
        held = np.empty((self.n_terms + len(self.left), parts.shape[1]), np.int64)
        held[: self.n_terms] = parts
        for level in self.levels:
            i = level - self.n_terms
            held[level] = held[self.left[i]] + held[self.right[i]]
        return np.add.reduceat(held[self.symbols], self.starts, axis=0)


def share(items: list[np.ndarray], n_terms: int) -> Sharing:
    """Mine the term sets that items (each a set of at least one term number) share."""
    own = [set(map(int, x)) for x in items]
    holders: dict[int, set[int]] = {}
    for i, s in enumerate(own):
        for x in s:
            holders.setdefault(x, set()).add(i)
    nodes: list[tuple[int, int]] = []
    while True:
        counts: Counter[tuple[int, int]] = Counter()
        for s in own:
            line = sorted((x for x in s if len(holders[x]) > 1), key=lambda x: (-len(holders[x]), x))
            for i, x in enumerate(line):
                for y in line[i + 1 : i + 1 + PAIRED]:
                    counts[x, y] += 1
        before = len(nodes)
        for (x, y), n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
            if n < 2:
                break
            both = holders[x] & holders[y]
            if len(both) < 2:  # others took what they had in common
                continue
            node = n_terms + len(nodes)
            nodes.append((x, y))
            holders[x], holders[y], holders[node] = holders[x] - both, holders[y] - both, both
            for i in both:
                own[i] -= {x, y}
                own[i].add(node)
        if len(nodes) == before:
            break
    depth = [0] * n_terms
    for x, y in nodes:
        depth.append(1 + max(depth[x], depth[y]))
    depth = np.array(depth)
    left = np.array([x for x, _ in nodes], np.int64)
    right = np.array([y for _, y in nodes], np.int64)
    levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
    rest = [sorted(s) for s in own]
    starts = np.cumsum([0, *(len(s) for s in rest)])[:-1]
    return Sharing(n_terms, left, right, levels, np.array([x for s in rest for x in s], np.int64), starts)


def item_classes(items: DataFrame, id_column: str) -> DataFrame:
    """(item, key, terms): the distinct terms of every item that has any, and a key of equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for _, _, offsets, data in ar.text_slices(batch.column(1)):
                h, at = terms(data, offsets)
                sets += [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]
            keys = [ar.content_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["item", "key", "terms"])

    kind = dict(items.dtypes)[id_column]
    found = items.select(F.col(id_column).alias("item"), "text").mapInArrow(ar.tidy(run), f"item {kind}, key long, terms array<long>")
    return runtime.write_scratch(found.filter("size(terms) > 0"), "item-terms")


def occurrences(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, at, tf): every document with a term, its terms counted, and where those of ``vocabulary`` (sorted hashes) stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, tf = [], [], []
            for _, _, offsets, data in ar.text_slices(batch.column(1)):
                h, bounds = terms(data, offsets)
                place = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                known = vocabulary[place] == h if len(vocabulary) else np.zeros(len(h), bool)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
                pair, count = np.unique(row[known] * max(len(vocabulary), 1) + place[known], return_counts=True)
                cut = np.searchsorted(pair, np.arange(len(offsets)) * max(len(vocabulary), 1))
                n += np.diff(bounds).tolist()
                at += np.split((pair % max(len(vocabulary), 1)).astype(np.int32), cut[1:-1])
                tf += np.split(count.astype(np.int64), cut[1:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "at", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(ar.tidy(run), "doc_id long, n long, at array<int>, tf array<long>").filter("n > 0")


class _Best:
    """The first ``k`` documents of every item so far: score downwards, doc_id upwards, rows without a doc_id last."""

    def __init__(self, items: int, k: int):
        self.k, self.need = k, np.ones(items, np.int64)
        self.item, self.doc, self.none, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        i, j = np.nonzero(scores >= self.need[:, None])
        if not len(i):
            return
        item, doc = np.append(self.item, i), np.append(self.doc, docs[j])
        none, score = np.append(self.none, none[j]), np.append(self.score, scores[i, j])
        order = np.lexsort((doc, none, -score, item))
        item, doc, none, score = item[order], doc[order], none[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.need[item[place == self.k - 1]] = score[place == self.k - 1]
        keep = place < self.k
        self.item, self.doc, self.none, self.score = item[keep], doc[keep], none[keep], score[keep]


def _rank_slices(sharing: Sharing, keys: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    step = max(1, HELD // max(1, sharing.n_terms + len(sharing.left) + len(sharing.symbols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(keys), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                at, tf = (part.column(c).flatten().to_numpy() for c in ("at", "tf"))
                row = np.repeat(np.arange(part.num_rows), part.column("at").value_lengths().to_numpy())
                length = LENGTH_LEAST + (LENGTH_SHARE * part.column("n").to_numpy() * n_docs) // n_terms
                parts = np.zeros((sharing.n_terms, part.num_rows), np.int64)
                parts[at, row] = weights[at] * ((GAIN * tf) // (TF_STEP * tf + LENGTH_STEP * length[row]))
                ids = part.column("doc_id")
                none = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
                best.offer(sharing.totals(parts), ids.fill_null(0).to_numpy(), none)
        yield pa.RecordBatch.from_arrays([pa.array(keys[best.item]), pa.array(best.doc, mask=best.none), pa.array(best.score)], ["key", "doc_id", "score"])

    return run


def _search(docs: DataFrame, block: pa.Table, k: int) -> DataFrame | None:
    """(key, doc_id, score, rank) of one block of item classes."""
    keys = block["key"].to_numpy()
    sets = [np.asarray(s.values.to_numpy()).view(np.uint64) for s in block["terms"].combine_chunks()]
    vocabulary = np.unique(np.concatenate(sets))
    found = runtime.write_scratch(occurrences(docs, vocabulary), "occurrences")
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    # One row a term of the block.
    for r in found.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).collect():
        weights[r["at"]] = math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    sharing = share([np.searchsorted(vocabulary, s) for s in sets], len(vocabulary))
    run = _rank_slices(sharing, keys, weights, n_docs, n_terms, k)
    scored = runtime.limit_tasks(found.filter("size(at) > 0")).mapInArrow(ar.tidy(run), "key long, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "item_id", block_items: int = BLOCK_ITEMS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(``id_column``, rank, doc_id, score): the ``k`` best documents of every item, of those with a score above 0.

    docs: ``doc_id`` and ``text``; items: ``id_column`` and ``text``; other columns are ignored. Equal scores are
    ordered by doc_id, rows without one last. Rows that repeat a doc_id are documents of their own, and so
    are items that repeat an id; items with equal term sets are evaluated once. Items without a term,
    and all items where no document has one, have no rows. Null texts have no terms.

    Items are taken in blocks by a hash of their term sets; a block reads the texts once and then only the
    table of its terms' occurrences. A task holds HELD accumulators whatever the texts and the block.
    """
    spark = docs.sparkSession
    runtime.ship_package(spark)
    named = item_classes(items, id_column)
    classes = named.dropDuplicates(["key"]).select("key", "terms")
    n, entries = classes.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-n // block_items), -(-(entries or 0) // block_entries))
    parts = []
    for b in range(blocks):
        block = classes.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow() if n else None
        if block is not None and block.num_rows:
            found = _search(docs, block.sort_by("key"), k)
            parts += [] if found is None else [found]
    if not parts:
        return spark.createDataFrame([], StructType([StructField(id_column, named.schema["item"].dataType)])).select(
            id_column, F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    best = reduce(DataFrame.unionByName, parts)
    return named.select(F.col("item").alias(id_column), "key").join(best, "key").select(id_column, "rank", "doc_id", "score")
