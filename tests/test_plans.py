"""Plan shapes that must hold whatever the size of the data."""

import re

import pytest
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.operators import dense, explain, fusion, lexical
from siftwell.operators.batch import QueryBatch
from siftwell.operators.index import define_index, save_index
from siftwell.sources import documents as src


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list[str]:
    return re.findall(r"(?<!Broadcast)Exchange (\w+partitioning\([^)]*\)|SinglePartition|RoundRobin\w*)", plan)


@pytest.fixture(scope="module")
def table(spark, docs):
    wide = docs.withColumn("embedding", F.array(*[F.lit(0.5).cast("float")] * 4))
    return src.write_documents(wide, runtime.scratch_path(spark, "p-docs"), "siftwell_plan_docs", 3)


@pytest.fixture(scope="module")
def saved(spark, table):
    return save_index(table, runtime.scratch_path(spark, "p-index"), "siftwell_plan_index", term_buckets=4, shards=3)


@pytest.fixture(scope="module")
def batch(queries):
    vec = F.array(*[F.lit(0.1).cast("float")] * 4)
    return QueryBatch.measure(queries.withColumn("embedding", vec))


def test_scores_on_a_saved_index_need_no_exchange(saved, batch):
    plan = plan_of(lexical.match_scores(saved, batch))
    assert exchanges(plan) == []
    assert "Bucketed: true" in plan and "dynamicpruning" in plan


def test_bm25_moves_only_the_short_lists(saved, batch):
    plan = plan_of(lexical.bm25_topk(lexical.match_scores(saved, batch)))
    assert len(exchanges(plan)) == 1
    partial = plan.index("Partial")
    assert plan.index("Exchange hashpartitioning(query_id") < partial
    assert "positions" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_lazy_index_scans_the_text_and_shuffles_no_postings(docs, batch):
    plan = plan_of(lexical.match_scores(define_index(docs), batch))
    on_pairs = [e for e in exchanges(plan) if "doc_id" in e]
    assert len(on_pairs) == 1 and "query_id" in on_pairs[0]


def test_text_is_analyzed_once_per_document(docs):
    plan = plan_of(define_index(docs).postings)
    assert plan.count("regexp_extract_all") == 1


def test_index_build_on_a_bucketed_table_has_no_exchange(table):
    plan = plan_of(define_index(table.repartition(3, "id")).postings)
    assert exchanges(plan) == []


def test_within_keeps_the_bucketing(saved, table, batch):
    ids = table.filter(F.contains("content", F.lit("pool"))).select(F.col("id").alias("doc_id"))
    plan = plan_of(lexical.match_scores(saved, batch, within=ids))
    assert exchanges(plan) == []


def test_vector_search_reads_two_columns_and_ranks_in_place(table, batch):
    vectors = table.filter(F.col("embedding").isNotNull()).select(F.col("id").alias("doc_id"), "embedding")
    plan = plan_of(dense.vector_topk(vectors, batch))
    assert "MapInArrow" in plan and "IsNotNull(embedding)" in plan
    assert "struct<id:bigint,embedding:array<float>>" in plan
    assert len(exchanges(plan)) == 1 and "WindowGroupLimit" in plan


def test_fusion_joins_short_lists_only(saved, table, batch):
    vectors = table.select(F.col("id").alias("doc_id"), "embedding")
    fused = fusion.rrf_topk(dense.vector_topk(vectors, batch), lexical.bm25_topk(lexical.match_scores(saved, batch)), batch)
    plan = plan_of(fused)
    assert plan.count("FullOuter") == 1 and "content" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_text_is_attached_by_broadcasting_the_short_list(saved, table, batch):
    best = lexical.bm25_topk(lexical.match_scores(saved, batch))
    plan = plan_of(explain.with_documents(best, table, batch))
    assert not any("id#" in e and "query_id" not in e for e in exchanges(plan))


def test_large_batches_broadcast_only_the_bounded_table_of_hot_terms(saved, table, queries):
    tight = QueryBatch.measure(queries, broadcast_bytes=0)
    logical = lambda df: df._jdf.queryExecution().logical().toString()
    best = lexical.bm25_topk(lexical.match_scores(saved, tight))
    assert logical(best).count("strategy=broadcast") == 2
    assert logical(explain.with_documents(best, table, tight)).count("strategy=broadcast") == 2
    assert logical(explain.with_query_terms(best, tight)).count("strategy=broadcast") == 2


def test_many_splits_are_merged_without_a_shuffle(spark):
    df = spark.range(0, 100, 1, 10)
    assert runtime.limit_tasks(df, 4).rdd.getNumPartitions() == 4
    assert runtime.limit_tasks(df, 10) is df
