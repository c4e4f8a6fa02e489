"""Score bounds: the same lists from fewer postings."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.operators import bounded, lexical
from siftwell.operators.analyze import Analyzer
from siftwell.operators.batch import QueryBatch
from siftwell.operators.index import save_index
from siftwell.sources import documents as src

K = 5


def texts(seed, n=400):
    """Documents of common and rare words, a third of them copies of one."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.choice([3, 20, 80])))
        rows.append((i + 1, f"t{i % 7}", rows[0][2] if rows and i % 3 == 0 else text, "c"))
    queries = [(q, " ".join(rng.choices(words, k=rng.choice([1, 4, 12]))), "keyword") for q in range(25)]
    return rows, queries + [(90, "nothing here", "keyword"), (91, "w0 w1 w2", "keyword"), (92, "w0 zzz", "keyword")]


@pytest.fixture(scope="module", params=[0, 1])
def case(spark, request):
    rows, queries = texts(request.param)
    docs = src.inline_documents(spark, rows)
    path = runtime.scratch_path(spark, "bounded-case")
    index = save_index(docs, path, f"bounded_case_{request.param}", Analyzer(), term_buckets=2, shards=3)
    bounds = bounded.save_bounds(index, path, blocks=1 + 3 * request.param)
    batch = QueryBatch.measure(spark.createDataFrame(queries, "query_id long, query string, category string"))
    return index, bounds, batch, path


def listed(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 7)) for r in df.collect())


def test_same_list_as_all_postings(case):
    index, bounds, batch, _ = case
    want = listed(lexical.bm25_topk(lexical.match_scores(index, batch), K))
    run = bounded.bounded_run(index, bounds, batch, K)
    assert listed(run.results) == want and want
    assert {r["stage"] for r in run.reads.select("stage").distinct().collect()} >= {"seeds", "read"}


def test_same_list_where_nothing_can_be_broadcast(case):
    from dataclasses import replace

    index, bounds, batch, _ = case
    small = replace(batch, broadcast_bytes=1)
    want = listed(lexical.bm25_topk(lexical.match_scores(index, batch), K))
    assert listed(bounded.bm25_topk_bounded(index, bounds, small, K)) == want


def test_bounds_hold_and_are_reached(case, spark):
    index, bounds, _, path = case
    part = bounded.sc.bm25_term(F.lit(1.0), F.col("tf"), F.col("doc_len"), index.avg_len())
    rows = index.postings.select("term", bounds.block(F.col("doc_len")).alias("block"), part.alias("part"))
    most = {(r["term"], r["block"]): (r["m"], r["n"]) for r in rows.groupBy("term", "block").agg(F.max("part").alias("m"), F.count("*").alias("n")).collect()}
    opened = bounded.load_bounds(spark, path)
    assert opened.edges == bounds.edges
    assert {(r["term"], r["block"]): (r["bound"], r["n"]) for r in opened.table.collect()} == most


def test_no_matches_and_no_queries(case, spark):
    index, bounds, batch, _ = case
    none = QueryBatch.measure(spark.createDataFrame([(1, "zzz yyy", "keyword")], "query_id long, query string, category string"))
    assert bounded.bm25_topk_bounded(index, bounds, none, K).count() == 0
    assert bounded.bm25_topk_bounded(index, bounds, batch.with_queries(batch.queries.limit(0)), K).count() == 0


def test_fewer_than_half_of_the_postings_for_context_questions(spark):
    """The first turns of the given conversations, as in ``rag_context``."""
    import os

    from workload.tables import corpus

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("given tables are not here")
    c = corpus(spark, sf)
    batch = c.agent_queries()
    scores = lexical.match_scores(c.index(), batch)
    run = bounded.bounded_run(c.index(), c.bounds(), batch, 10)
    assert listed(run.results) == listed(lexical.bm25_topk(scores, 10))
    every = scores.agg(F.sum("n_matched")).first()[0]
    assert run.reads.agg(F.sum("n")).first()[0] < every / 2
