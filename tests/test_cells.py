"""Cells with residual codes: approximate search, and exact search that leaves cells out."""

from dataclasses import replace

import numpy as np
import pytest

from siftwell import runtime
from siftwell.operators import cells as cl
from siftwell.operators import dense
from siftwell.operators.batch import QueryBatch

K = 4
DIMS = 10


def clustered(seed=0, n=600):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, DIMS))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.15, size=(n, DIMS))
    x[::3] = x[0]  # a third of the rows are one vector
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(9000, [0.0] * DIMS), (9001, None), (9002, [1.0, 2.0])]
    queries = [(q, "q", [float(np.float32(v)) for v in x[q * 7 % n] + rng.normal(scale=0.05, size=DIMS)]) for q in range(30)]
    return rows, queries + [(70, "q", rows[0][1]), (71, "q", [0.0] * DIMS), (72, "q", None)]


@pytest.fixture(scope="module")
def case(spark):
    rows, queries = clustered()
    vectors = runtime.write_scratch(spark.createDataFrame(rows, "doc_id long, embedding array<float>"), "cell-case")
    path = runtime.scratch_path(spark, "cell-case-index")
    batch = QueryBatch.measure(spark.createDataFrame(queries, "query_id long, query string, embedding array<float>"))
    return vectors, cl.save_cells(vectors, path), batch, path


def listed(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["distance"], 7)) for r in df.collect())


def test_every_vector_has_one_first_cell(case, spark):
    vectors, index, _, path = case
    rows = index.table.collect()
    first = [r["doc_id"] for r in rows if not r["second"]]
    assert sorted(first) == list(range(600)) and index.n_vectors() == 600
    assert any(r["second"] for r in rows) and len(index.centres) <= cl.cells_for(601)
    again = cl.load_cells(spark, path)
    assert np.array_equal(again.centres, index.centres) and np.array_equal(again.sizes, index.sizes)
    assert all(np.array_equal(a, b) for a, b in zip(again.books, index.books))


def test_pruned_search_is_exact_and_reads_less(case):
    vectors, index, batch, _ = case
    want = listed(dense.vector_topk(vectors, batch, K))
    run = cl.pruned_search(index, batch, K)
    assert listed(run.results) == want and want
    reads = run.reads.collect()
    assert sum(r["n_rows"] for r in reads) < 0.5 * len(reads) * index.n_vectors()
    assert max(r["n_cells"] for r in reads) <= len(index.centres)


def test_queries_in_blocks(case):
    vectors, index, batch, _ = case
    small = replace(batch, broadcast_bytes=600)
    assert listed(cl.pruned_search(index, small, K).results) == listed(dense.vector_topk(vectors, batch, K))
    assert listed(cl.approximate_topk(index, small, K)) == listed(cl.approximate_topk(index, batch, K))


def test_approximate_search_finds_most_and_ranks_few(case):
    vectors, index, batch, _ = case
    near = cl.approximate_topk(index, batch, K, rerank=60)
    rows = near.collect()
    exact = {(r["query_id"], round(r["distance"], 7)) for r in dense.vector_topk(vectors, batch, K).collect()}
    found = {(r["query_id"], round(r["distance"], 7)) for r in rows}
    assert len(found & exact) >= 0.95 * len(exact)
    assert {r["n_exact"] for r in cl.ranked_counts(index, batch, K, rerank=60).collect()} == {60}


def test_all_cells_and_all_rows_are_exact(case):
    vectors, index, batch, _ = case
    near = cl.approximate_topk(index, batch, K, n_probe=len(index.centres), rerank=700)
    assert listed(near) == listed(dense.vector_topk(vectors, batch, K))


def test_more_results_than_vectors_and_no_vectors(spark):
    rows, queries = clustered()
    batch = QueryBatch.measure(spark.createDataFrame(queries[:3], "query_id long, query string, embedding array<float>"))
    for n in (0, 1, 3):
        vectors = spark.createDataFrame([r for r in rows[1:] if r[1]][:n], "doc_id long, embedding array<float>")
        index = cl.save_cells(vectors, runtime.scratch_path(spark, f"cells-of-{n}"))
        want = listed(dense.vector_topk(vectors, batch, K))
        assert listed(cl.pruned_search(index, batch, K).results) == want and len(want) == 3 * n
        assert listed(cl.approximate_topk(index, batch, K, n_probe=9)) == want


def test_the_number_of_cells_grows(spark):
    assert [cl.cells_for(n) for n in (0, 1, 100, 10_000, 10**12)] == [1, 1, 10, 100, cl.MAX_CELLS]
