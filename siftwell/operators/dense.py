"""Vector retrieval: exact top-k by cosine distance, and cells for approximate top-k.

Exact search scores every document vector against every query vector. While the
query vectors fit the broadcast limit, the document vectors are streamed once
where they lie and each task keeps only its best ``k`` rows per query; a few times
the limit is cut into as many blocks of queries. Beyond that the same kernel runs on a grid of bounded blocks of both sides.
Approximate search compares a query with the cells closest to it only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import scoring as sc
from siftwell.operators import topk
from siftwell.operators.batch import ROW_OVERHEAD, QueryBatch
from siftwell.operators.best import BestRows, groups
from siftwell.schema import NEIGHBOURS

# Fixed value: entries of one distance block held by a task (doubles, 32 MB).
BLOCK_ENTRIES = 1 << 22
# Fixed value: bytes of one side of a grid block as a matrix of doubles (256 MB).
GRID_BYTES = 1 << 28
# Fixed value: blocks of queries that are broadcast one by one; more go on a grid.
MOST_BLOCKS = 16
# Distances closer than SLACK may be equal when rounded; rows that all tasks of a scan return together.
SLACK, RETURNED_ROWS = 1e-8, 1 << 22

_OUT = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("distance", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows had a length at all."""
    norms = np.sqrt((matrix * matrix).sum(axis=1)) if matrix.size else np.zeros(len(matrix))
    usable = norms > 0
    return matrix / np.where(usable, norms, 1.0)[:, None], usable


class _BestRows(BestRows):
    """Running best ``k`` rows per query under (distance to nine decimals, id)."""

    def __init__(self, query_ids: np.ndarray, k: int):
        super().__init__(len(query_ids), k)
        self.query_ids = query_ids

    @property
    def q(self) -> np.ndarray:
        return np.nonzero(self.filled())[0]

    @property
    def ids(self) -> np.ndarray:
        return self.id[self.filled()]

    def offer(self, rows: np.ndarray, doc_ids: np.ndarray, dist: np.ndarray) -> None:
        """``dist[i, j]`` is the distance of query ``rows[i]`` to ``doc_ids[j]``."""
        limit = self.limit[rows]
        fresh = np.isinf(limit)
        if fresh.any() and dist.shape[1] > self.k:
            # The k-th of a part is no better than the k-th of all.
            kth = np.partition(dist if fresh.all() else dist[fresh], self.k - 1, axis=1)[:, self.k - 1]
            limit[fresh] = np.where(np.isnan(kth), np.inf, kth)
        qi, dj = np.nonzero(dist <= (limit + SLACK)[:, None])
        near = dist[qi, dj]
        self.add(rows[qi], doc_ids[dj], near, np.round(near, sc.RANK_DECIMALS))

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(self.query_ids[self.q]), pa.array(self.ids), pa.array(self.value[self.filled()])]
        return pa.RecordBatch.from_arrays(arrays, schema=_OUT)


def _offer_blocks(best: _BestRows, rows: np.ndarray, queries: np.ndarray,
                  doc_ids: np.ndarray, docs: np.ndarray) -> None:
    """Score in pieces so that no distance block exceeds BLOCK_ENTRIES."""
    q_step = max(1, min(len(rows), 4096))
    d_step = max(1, BLOCK_ENTRIES // q_step)
    for i in range(0, len(rows), q_step):
        part = rows[i:i + q_step]
        for j in range(0, len(doc_ids), d_step):
            dist = 1.0 - queries[part] @ docs[j:j + d_step].T
            best.offer(part, doc_ids[j:j + d_step], dist)


def _usable(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors that are present and have the dimension of the queries."""
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims))


def _query_vectors(batch: QueryBatch) -> DataFrame:
    return _usable(batch.queries, batch.n_dims).select("query_id", "embedding")


def _vector_bytes(batch: QueryBatch) -> int:
    return batch.n_queries * (ROW_OVERHEAD + batch.n_dims * 8)


def _vectors_fit(batch: QueryBatch) -> bool:
    return _vector_bytes(batch) <= batch.broadcast_bytes


def _collect_queries(batch: QueryBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the queries; called only when they fit the limit."""
    table = _query_vectors(batch).toArrow().combine_chunks()
    ids = table["query_id"].to_numpy()
    lists = table["embedding"].combine_chunks() if len(ids) else None
    unit, usable = _unit_rows(_matrix(lists)) if len(ids) else (np.zeros((0, 0)), np.zeros(0, bool))
    return ids[usable], unit[usable]


def nearest_rows(vectors: DataFrame, batch: QueryBatch, k: int) -> DataFrame:
    """At least the exact ``k`` nearest rows per query, ``k`` per task at most.

    Splits are merged, without a shuffle, until the tasks return few rows together.
    """
    docs = _usable(vectors, batch.n_dims).select("doc_id", "embedding")
    if _vector_bytes(batch) > MOST_BLOCKS * batch.broadcast_bytes:
        return _nearest_on_grid(docs, batch, k)
    blocks = max(1, math.ceil(_vector_bytes(batch) / max(1, batch.broadcast_bytes)))
    if blocks == 1:
        return _nearest_in_place(docs, batch, k)
    block = _blocks("query_id", blocks)
    return reduce(DataFrame.unionByName, [
        _nearest_in_place(docs, batch.with_queries(batch.queries.filter(block == i)), k) for i in range(blocks)
    ])


def _nearest_in_place(docs: DataFrame, batch: QueryBatch, k: int) -> DataFrame:
    """Stream the vectors where they lie past the queries, which fit a broadcast."""
    docs = docs.coalesce(min(runtime.MAX_SHARDS, max(groups(docs), RETURNED_ROWS // max(1, k * batch.n_queries))))
    shared = docs.sparkSession.sparkContext.broadcast(_collect_queries(batch))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = _BestRows(ids, k)
        rows = np.arange(len(ids))
        for b in batches:
            unit, usable = _unit_rows(_matrix(b.column("embedding")))
            if len(ids) and usable.any():
                doc_ids = b.column("doc_id").to_numpy()
                _offer_blocks(best, rows, queries, doc_ids[usable], unit[usable])
        yield best.batch()

    return docs.mapInArrow(scan, NEIGHBOURS)


def _score_pair(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Best rows of one block of documents for one block of queries."""
    left, right = left.combine_chunks(), right.combine_chunks()
    if not len(left) or not len(right):
        return _OUT.empty_table()
    docs, d_ok = _unit_rows(_matrix(left["embedding"].combine_chunks()))
    queries, q_ok = _unit_rows(_matrix(right["embedding"].combine_chunks()))
    best = _BestRows(right["query_id"].to_numpy(), k)
    rows = np.nonzero(q_ok)[0]
    if len(rows) and d_ok.any():
        _offer_blocks(best, rows, queries, left["doc_id"].to_numpy()[d_ok], docs[d_ok])
    return pa.Table.from_batches([best.batch()])


def _grid_rows(batch: QueryBatch) -> int:
    return max(1, GRID_BYTES // (8 * max(1, batch.n_dims)))


def _blocks(id_column: str, n: int):
    return F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int")


def _nearest_on_grid(docs: DataFrame, batch: QueryBatch, k: int,
                     grid_rows: int | None = None) -> DataFrame:
    """Exact search when the queries are too many to broadcast.

    Both sides are cut by a hash of their unique ids into blocks of about
    ``grid_rows`` rows, every block of one side meets every block of the other
    in its own group, and a group returns ``k`` rows per query. Group sizes do
    not depend on the data, so no key can grow hot.
    """
    grid_rows = grid_rows or _grid_rows(batch)
    q_blocks = max(1, math.ceil(batch.n_queries / grid_rows))
    d_blocks = max(1, math.ceil(docs.count() / grid_rows))
    left = docs.withColumn("_d", _blocks("doc_id", d_blocks)).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    right = _query_vectors(batch).withColumn("_q", _blocks("query_id", q_blocks)).withColumn(
        "_d", F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1)))
    )

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        return _score_pair(a, b, k)

    return left.groupBy("_d", "_q").cogroup(right.groupBy("_d", "_q")).applyInArrow(pair, NEIGHBOURS)


def vector_topk(vectors: DataFrame, batch: QueryBatch, k: int = 10) -> DataFrame:
    """Exact nearest documents per query: ``query_id, doc_id, distance, similarity, rank``.

    ``vectors`` has ``doc_id, embedding``; vectors of length zero match nothing.
    """
    best = topk.top_k(nearest_rows(vectors, batch, k), k, "distance", descending=False)
    return best.withColumn("similarity", sc.similarity(F.col("distance")))


def vector_topk_above(neighbours: DataFrame, batch: QueryBatch) -> DataFrame:
    """Keep neighbours strictly closer than the query's threshold in percent similarity."""
    return batch.apply_threshold(
        neighbours, F.col("distance") < F.lit(1.0) - F.col("threshold") / F.lit(100.0)
    )


def labelled(neighbours: DataFrame, high: float = sc.HIGH_SIMILARITY,
             moderate: float = sc.MODERATE_SIMILARITY) -> DataFrame:
    return neighbours.withColumn("label", sc.similarity_class(F.col("similarity"), high, moderate))


# -- approximate search ------------------------------------------------------


def _unit_features(vectors: DataFrame) -> DataFrame:
    raw = vectors.filter(F.col("embedding").isNotNull()).withColumn("_raw", array_to_vector("embedding"))
    return Normalizer(inputCol="_raw", outputCol="_unit", p=2.0).transform(raw).drop("_raw")


def train_cells(vectors: DataFrame, n_cells: int, train_rows_per_cell: int = 256,
                seed: int = 7) -> KMeansModel:
    """Choose ``n_cells`` centres on the unit sphere.

    Only the choice of centres uses a sample; every vector is put in a cell
    later. Where the cells lie affects recall, never which rows exist.
    """
    features = _unit_features(vectors).select("_unit")
    wanted = n_cells * train_rows_per_cell
    total = features.count()
    if total > wanted:
        features = features.sample(fraction=wanted / total, seed=seed)
    return KMeans(k=n_cells, seed=seed, maxIter=20, featuresCol="_unit", predictionCol="cell").fit(features)


def assign_cells(vectors: DataFrame, model: KMeansModel) -> DataFrame:
    """``doc_id, embedding, cell``: unit vectors with the cell of their nearest centre."""
    placed = model.transform(_unit_features(vectors))
    return placed.select("doc_id", vector_to_array("_unit", "float32").alias("embedding"), "cell")


def save_cells(cells: DataFrame, path: str) -> DataFrame:
    """Write the cell table partitioned by ``cell`` and read it back.

    The rebalance hint gathers small cells and splits one that holds a large
    share of all vectors over several files.
    """
    spark = cells.sparkSession
    cells.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return spark.read.parquet(path)


def _nearest_cells(unit: np.ndarray, centres: np.ndarray, n_probe: int) -> np.ndarray:
    """For each row the indices of its ``n_probe`` nearest centres (Euclidean)."""
    gap = (centres * centres).sum(axis=1)[None, :] - 2.0 * (unit @ centres.T)
    return np.argsort(gap, axis=1, kind="stable")[:, :n_probe]


def ann_topk(cells: DataFrame, model: KMeansModel, batch: QueryBatch,
             k: int = 10, n_probe: int = 4) -> DataFrame:
    """Approximate nearest documents: only the ``n_probe`` closest cells of a query.

    Within those cells the ranking is exact, so probing all cells gives the
    exact result.
    """
    centres = np.array(model.clusterCenters())
    n_probe = min(n_probe, len(centres))
    if _vectors_fit(batch):
        rows = _probe_by_broadcast(cells, centres, batch, k, n_probe)
    else:
        rows = _probe_by_join(cells, centres, batch, k, n_probe)
    best = topk.top_k(rows, k, "distance", descending=False)
    return best.withColumn("similarity", sc.similarity(F.col("distance")))


def _probe_by_broadcast(cells: DataFrame, centres: np.ndarray, batch: QueryBatch,
                        k: int, n_probe: int) -> DataFrame:
    ids, queries = _collect_queries(batch)
    probes = _nearest_cells(queries, centres, n_probe) if len(ids) else np.zeros((0, n_probe), int)
    visited = [int(c) for c in np.unique(probes)]
    members = {c: np.nonzero((probes == c).any(axis=1))[0] for c in visited}
    shared = cells.sparkSession.sparkContext.broadcast((ids, queries, members))
    # The list has at most n_cells entries and prunes the partitions of the table.
    near = _usable(cells, batch.n_dims).filter(F.col("cell").isin(visited))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, members = shared.value
        best = _BestRows(ids, k)
        for b in batches:
            unit, usable = _unit_rows(_matrix(b.column("embedding")))
            cell = b.column("cell").to_numpy()
            doc_ids = b.column("doc_id").to_numpy()
            for c in np.unique(cell[usable]):
                here = usable & (cell == c)
                _offer_blocks(best, members[int(c)], queries, doc_ids[here], unit[here])
        yield best.batch()

    rows = runtime.limit_tasks(near.select("doc_id", "embedding", "cell"))
    return rows.mapInArrow(scan, NEIGHBOURS)


def _probe_by_join(cells: DataFrame, centres: np.ndarray, batch: QueryBatch,
                   k: int, n_probe: int, grid_rows: int | None = None) -> DataFrame:
    """Equi-join of probes and vectors on the cell, with large cells split.

    Counts per cell (at most n_cells rows on either side) say into how many
    blocks a cell has to be cut; blocks are chosen by a hash of the unique id.
    """
    grid_rows = grid_rows or _grid_rows(batch)
    shared = cells.sparkSession.sparkContext.broadcast(centres)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, usable = _unit_rows(_matrix(b.column("embedding")))
            b = b.filter(pa.array(usable))
            near = _nearest_cells(unit[usable], shared.value, n_probe)
            repeated = b.take(pa.array(np.repeat(np.arange(len(near)), n_probe)))
            yield pa.RecordBatch.from_arrays(
                [repeated.column("query_id"), repeated.column("embedding"),
                 pa.array(near.reshape(-1).astype(np.int32))],
                names=["query_id", "embedding", "cell"],
            )

    probes = _query_vectors(batch).mapInArrow(probe, "query_id long, embedding array<float>, cell int")
    docs = _usable(cells, batch.n_dims).select("doc_id", "embedding", "cell")

    def pieces(df: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.count(F.lit(1)) / F.lit(grid_rows)).cast("int")
        return df.groupBy("cell").agg(n.alias(name))

    sizes = F.broadcast(pieces(docs, "_nd").join(pieces(probes, "_nq"), "cell"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = docs.join(sizes, "cell").withColumn("_d", block("doc_id", "_nd")).withColumn("_q", spread("_nq"))
    right = probes.join(sizes, "cell").withColumn("_q", block("query_id", "_nq")).withColumn("_d", spread("_nd"))
    keys = ["cell", "_d", "_q"]

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        return _score_pair(a, b, k)

    return left.drop("_nd", "_nq").groupBy(*keys).cogroup(
        right.drop("_nd", "_nq").groupBy(*keys)
    ).applyInArrow(pair, NEIGHBOURS)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query, the share of the exact neighbours that were found."""
    found = approximate.select("query_id", "doc_id", F.lit(1).alias("_hit"))
    return (
        exact.select("query_id", "doc_id").join(found, ["query_id", "doc_id"], "left")
        .groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
    )
