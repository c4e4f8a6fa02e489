"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors again and again along a random direction at the
median; vectors near a split go to both sides. Trees are fitted on a bounded sample,
every vector is indexed. Vectors in one leaf are compared in blocks of matrix
products, and a pair counts in the first leaf that both share, so no pair is
shuffled: a leaf returns for each vector how many links it found, and links that
span its components. Equal vectors are one class from the start.

A leaf of any size is cut into blocks, and every pair of blocks is a task of its
own, so a dense cluster, which no split can part, is exact and spread out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.llm.components import connected_components

# Trees, half the width of the overlap at a split times the root of the dimension (projections of
# unit vectors shrink with it), vectors of a leaf aimed at and of a block at most.
TREES, OVERLAP, LEAF, BLOCK = 6, 0.16, 256, 2048
#: Vectors that the splits are fitted on, and of them in a leaf, at least.
SAMPLE, LEAST = 20_000, 8
#: Components of vectors that are sent down the trees at a time.
NUMBERS = 1 << 19


@dataclass
class Forest:
    """Directions and thresholds of the inner nodes, in heap order, of each tree."""

    depth: int
    directions: np.ndarray  # (trees, nodes, dimensions)
    thresholds: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf each unit vector belongs to."""
        rows, leaves, overlap = [], [], OVERLAP / np.sqrt(x.shape[1])
        for tree in range(len(self.directions)):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x[row], self.directions[tree][node]) - self.thresholds[tree][node]
                left, right = side <= overlap, side > -overlap
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows.append(row)
            leaves.append(node - (2**self.depth - 1) + tree * 2**self.depth)
        return np.concatenate(rows), np.concatenate(leaves)


def fit_forest(sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> Forest:
    """Splits at the sample's medians, as deep as ``n`` vectors need and the sample allows."""
    rng = np.random.default_rng(seed)
    want = np.ceil(np.log2(max(1, n / leaf)))
    depth = int(max(0, min(want, np.floor(np.log2(max(1, len(sample) / LEAST))))))
    nodes, dims = max(1, 2**depth - 1), sample.shape[1] if sample.ndim == 2 else 1
    directions, thresholds = np.zeros((trees, nodes, dims)), np.zeros((trees, nodes))
    for tree in range(trees):
        held = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            own = held.pop(node)
            d = rng.normal(size=dims)
            directions[tree, node] = d / np.linalg.norm(d)
            side = sample[own] @ directions[tree, node]
            thresholds[tree, node] = np.median(side) if len(own) else 0.0
            held[2 * node + 1], held[2 * node + 2] = own[side <= thresholds[tree, node]], own[side > thresholds[tree, node]]
    return Forest(depth, directions, thresholds)


def _units(column: pa.Array) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(shared):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, found = _units(batch.column("embedding")), []
            step = max(1, NUMBERS // x.shape[1])
            for lo in range(0, len(x), step):
                row, leaf = shared.value.leaves(x[lo : lo + step])
                order = np.lexsort((leaf, row))
                found.append((row[order] + lo, leaf[order]))
            row, leaf = (np.concatenate(c) for c in zip(*found))
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("copies"), batch.column("embedding"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(leaf, pa.int64())),
            ], ["node", "copies", "embedding", "leaves"])

    return run


def _numbered(lists: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct lists and the number of each row's."""
    seen: dict[bytes, int] = {}
    out, at = [], np.empty(len(lists), np.int64)
    for i, x in enumerate(lists):
        key = x.tobytes()
        if key not in seen:
            seen[key] = len(out)
            out.append(x)
        at[i] = seen[key]
    return out, at


def _earlier(a: list[np.ndarray], b: list[np.ndarray], leaf: int) -> np.ndarray:
    """Which pairs of leaf lists share a leaf before ``leaf``."""
    place: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        for v in x[x < leaf]:
            place.setdefault(int(v), []).append(j)
    out = np.zeros((len(a), len(b)), bool)
    for i, x in enumerate(a):
        for v in x[x < leaf]:
            out[i, place.get(int(v), [])] = True
    return out


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of ``n`` places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(least: float):
    """Links within one pair of blocks of one leaf."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        leaf, low, high = (k.as_py() for k in key)
        table = table.combine_chunks()
        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        x = _units(table.column("embedding").combine_chunks())
        lists, which = _numbered([v.values.to_numpy() for v in table.column("leaves")])
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        seen = _earlier(lists, lists, leaf)
        found = []
        for lo in range(0, len(a), 512):
            i, j = np.nonzero(x[a[lo : lo + 512]] @ x[b].T >= least)
            i = i + lo
            if low == high:
                i, j = i[i < j], j[i < j]
            found.append(np.stack([a[i], b[j]]))
        p, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        root = _roots(len(node), p, q)
        new = ~seen[which[p], which[q]]
        links = np.bincount(p[new], copies[q[new]], len(node)) + np.bincount(q[new], copies[p[new]], len(node))
        held = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
        return pa.table({"node": pa.array(node[held]), "links": pa.array(links[held].astype(np.int64)), "root": pa.array(node[root[held]])})

    return run


def vector_links(vectors: DataFrame, least: float = 0.9, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vec_id``, ``embedding``.

    n_links counts the other rows linked directly, equal vectors included. A vector that is null or
    empty, has null or non-finite components, or is zero, links with nothing, and so does one of
    another length than most have (of lengths equally frequent the shorter counts). Rows with
    one vec_id are rows of their own.
    """
    spark = vectors.sparkSession
    runtime.ship_package(spark)
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("valid", F.coalesce(fine, F.lit(False)))
    usual = rows.filter("valid").groupBy(F.size(e).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    rows = rows.withColumn("valid", F.col("valid") & (F.size(e) == (usual["dims"] if usual else 0)))
    # -0.0 and 0.0 are one number.
    same = F.transform("embedding", lambda v: F.when(v == 0, v * 0 + F.lit(0).cast("float")).otherwise(v))
    valid = rows.filter("valid").select("vec_id", same.alias("embedding"))
    classes = valid.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = runtime.write_scratch(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("first_id", "node")).limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    forest = fit_forest(_units(sample) if len(sample) else np.zeros((0, 1)), n, trees, leaf)
    shared = spark.sparkContext.broadcast(forest)
    kind = dict(classes.dtypes)["embedding"]
    indexed = classes.select("node", "copies", "embedding").mapInArrow(_index(shared), f"node long, copies long, embedding {kind}, leaves array<long>")
    indexed = runtime.write_scratch(indexed, "leaves")
    # At most trees * sample / LEAST rows.
    sizes = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = indexed.select("node", "copies", "embedding", "leaves", F.explode("leaves").alias("leaf")).join(F.broadcast(sizes), "leaf")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = placed.select(
        "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "embedding", "leaves"
    ).groupBy("leaf", "low", "high")
    found = runtime.write_scratch(groups.applyInArrow(_compare(least), "node long, links long, root long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("node", "root"), "node", "root")
    named = classes.select("node", "first_id", "copies", F.xxhash64("embedding").alias("h"), "embedding").join(links, "node", "left")
    named = named.join(parts.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").withColumn("comp", F.coalesce("root", "node"))
    least_id = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = named.join(least_id, "comp").select("h", F.col("embedding").alias("class_vector"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    all_rows = rows.select("vec_id", "valid", F.when(F.col("valid"), same).alias("embedding")).withColumn("h", F.xxhash64("embedding"))
    out = all_rows.join(named, (all_rows.h == named.h) & F.col("valid") & (F.col("embedding") == F.col("class_vector")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
