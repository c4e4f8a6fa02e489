import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.operators import dense, embed
from siftwell.operators.batch import QueryBatch

DIMS = 8


def make_vectors(n=400, seed=3):
    """Random vectors; a third are copies of one vector, one has length zero."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, DIMS)).astype(np.float32)
    rows[::3] = rows[0]
    rows[7] = 0
    return rows


VECTORS = make_vectors()
ASKED = np.vstack([VECTORS[[0, 1, 2]] * 5, make_vectors(9, seed=4)[1:9]])


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(VECTORS)] + [(9001, None), (9002, [1.0, 2.0])]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(5)


def asked(spark, broadcast_bytes=runtime.BROADCAST_BYTES):
    rows = [(i, "q", v.tolist()) for i, v in enumerate(ASKED)] + [(99, "no vector", None)]
    return QueryBatch.measure(spark.createDataFrame(rows, "query_id long, query string, embedding array<float>"), broadcast_bytes)


def model(k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    docs = [i for i in range(len(VECTORS)) if VECTORS[i].any()]
    d = 1 - unit(ASKED.astype(np.float64)) @ unit(VECTORS[docs].astype(np.float64)).T
    out = {}
    for q in range(len(ASKED)):
        if ASKED[q].any():
            best = sorted((round(x, 9), i) for x, i in zip(d[q], docs))[:k]
            out |= {(q, rank + 1): i for rank, (_, i) in enumerate(best)}
    return out


def ranks(df):
    return {(r["query_id"], r["rank"]): r["doc_id"] for r in df.collect()}


@pytest.mark.parametrize("k", [1, 10, 150])
def test_exact_neighbours_with_many_ties(spark, vectors, k):
    assert ranks(dense.vector_topk(vectors, asked(spark), k)) == model(k)


def test_small_blocks_give_the_same(spark, vectors, monkeypatch):
    best = dense._BestRows(np.arange(len(ASKED)), 5)
    monkeypatch.setattr(dense, "BLOCK_ENTRIES", 16)
    queries, _ = dense._unit_rows(ASKED.astype(float))
    docs, ok = dense._unit_rows(VECTORS.astype(float))
    rows = np.nonzero(ASKED.any(axis=1))[0]
    dense._offer_blocks(best, rows, queries, np.arange(len(docs))[ok], docs[ok])
    got = {}
    for q, i in zip(best.q, best.ids):
        got[q, sum(1 for a, _ in got if a == q) + 1] = i
    assert got == model(5)


def test_grid_search_beyond_the_broadcast_limit(spark, vectors):
    batch = asked(spark, broadcast_bytes=0)
    docs = dense._usable(vectors, DIMS).select("doc_id", "embedding")
    from siftwell.operators import topk
    rows = dense._nearest_on_grid(docs, batch, 10, grid_rows=4)
    assert ranks(topk.top_k(rows, 10, "distance", descending=False)) == model(10)
    assert ranks(dense.vector_topk(vectors, batch, 10)) == model(10)


def test_query_vectors_of_another_dimension_find_nothing(spark, vectors):
    rows = [(1, "q", [1.0] * DIMS), (2, "q", [1.0, 2.0])]
    batch = QueryBatch.measure(spark.createDataFrame(rows, "query_id long, query string, embedding array<float>"))
    for b in (batch, QueryBatch.measure(batch.queries, broadcast_bytes=0)):
        assert {r["query_id"] for r in dense.vector_topk(vectors, b, 3).collect()} == {1}


def test_distance_is_independent_of_scale_and_complements_similarity(spark, vectors):
    row = dense.vector_topk(vectors, asked(spark), 1).filter("query_id = 1").first()
    assert row["distance"] == pytest.approx(0, abs=1e-9)
    assert row["similarity"] == pytest.approx(1 - row["distance"])


def test_threshold_is_strict_percent(spark, vectors):
    batch = asked(spark)
    near = dense.vector_topk(vectors, batch, 10)
    edge = near.filter("query_id = 5 and rank = 3").first()["similarity"] * 100
    limited = batch.with_queries(batch.queries.withColumn("threshold", F.when(F.col("query_id") == 5, F.lit(edge))))
    kept = {(r["query_id"], r["rank"]) for r in dense.vector_topk_above(near, limited).collect()}
    assert {r for q, r in kept if q == 5} <= {1, 2, 3} and (5, 1) in kept
    assert sum(q == 1 for q, _ in kept) == 10


@pytest.fixture(scope="module")
def cells(spark, vectors):
    model_ = dense.train_cells(vectors.filter("size(embedding) = 8"), 6)
    placed = dense.assign_cells(vectors.filter("size(embedding) = 8"), model_)
    return dense.save_cells(placed, runtime.scratch_path(spark, "t-cells")), model_


def test_probing_all_cells_is_exact(spark, cells):
    table, model_ = cells
    want = ranks(dense.ann_topk(table, model_, asked(spark), 10, n_probe=6))
    # Stored vectors are single-precision unit vectors: compare by distance, not by tied id.
    exact = dense.vector_topk(table.select("doc_id", "embedding"), asked(spark), 10)
    assert want == ranks(exact)
    joined = ranks(dense.ann_topk(table, model_, asked(spark, 0), 10, n_probe=6))
    assert joined == want


def test_both_ways_of_probing_agree_and_recall_is_a_share(spark, vectors, cells):
    table, model_ = cells
    a = dense.ann_topk(table, model_, asked(spark), 10, n_probe=2)
    b = dense.ann_topk(table, model_, asked(spark, 0), 10, n_probe=2)
    assert ranks(a) == ranks(b)
    rows = dense._probe_by_join(table, np.array(model_.clusterCenters()), asked(spark, 0), 10, 2, grid_rows=3)
    from siftwell.operators import topk
    assert ranks(topk.top_k(rows, 10, "distance", descending=False)) == ranks(a)
    shares = [r["recall"] for r in dense.recall(a, dense.vector_topk(table, asked(spark), 10)).collect()]
    assert len(shares) == len({q for q, _ in model(1)}) and all(0 <= s <= 1 for s in shares) and max(shares) == 1


def test_cell_table_holds_every_usable_vector_once(cells):
    table, _ = cells
    ids = [r["doc_id"] for r in table.select("doc_id").collect()]
    assert sorted(ids) == list(range(len(VECTORS)))


def test_embedder_failures_leave_null(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "fine")], "id long, full_text string")

    def model_(texts):
        if "bad" in texts:
            raise RuntimeError("cannot embed")
        return [[float(len(t)), 1.0] for t in texts]

    got = {r["doc_id"]: r["embedding"] for r in embed.embed_documents(rows.coalesce(1), model_).collect()}
    assert got == {1: [4.0, 1.0], 2: None, 3: None, 4: [4.0, 1.0]}


def test_hashed_embeddings_are_unit_length_and_merge(spark, docs):
    vectors_ = embed.hashed_embeddings(docs, dims=64)
    merged = embed.merge_embeddings(docs, vectors_.filter("doc_id <> 3"))
    rows = {r["id"]: r["embedding"] for r in merged.collect()}
    assert rows[3] is None and len(rows) == 15
    assert all(np.linalg.norm(v) == pytest.approx(1, abs=1e-5) for v in rows.values() if v)
    cover = embed.coverage(merged).first()
    assert (cover["n_embedded"], cover["avg_dims"]) == (14, 64.0)
    empty = spark.createDataFrame([(1, "...")], "id long, full_text string")
    assert embed.hashed_embeddings(empty.union(docs.select("id", "full_text")), 16).filter("embedding is null").count() == 1


def test_a_scan_over_many_splits_returns_few_rows(spark, vectors, monkeypatch):
    monkeypatch.setattr(dense, "RETURNED_ROWS", 1)
    split = vectors.repartition(90)
    most = dense.groups(split)
    assert dense.nearest_rows(split, asked(spark), 1).count() <= most * len(ASKED)
    assert ranks(dense.vector_topk(split, asked(spark), 10)) == model(10)


def test_queries_beyond_one_broadcast_are_cut_into_blocks(spark, vectors, monkeypatch):
    batch = asked(spark, broadcast_bytes=2 * (100 + 8 * DIMS))
    monkeypatch.setattr(dense, "_nearest_on_grid", None)
    assert ranks(dense.vector_topk(vectors, batch, 10)) == model(10)
