"""The four methods side by side, and how well each one does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.batch import QueryBatch

METHODS = ("boolean", "bm25", "vector", "hybrid")


def side_by_side(lists: dict[str, DataFrame]) -> DataFrame:
    """``method, query_id, doc_id, rank, score`` of several result lists."""
    def shaped(method: str) -> DataFrame:
        return lists[method].select(
            F.lit(method).alias("method"), "query_id", "doc_id", "rank", F.col("score").cast("double").alias("score")
        )

    return reduce(DataFrame.unionByName, [shaped(m) for m in lists])


def visible(combined: DataFrame, methods: list[str]) -> DataFrame:
    return combined.filter(F.col("method").isin(methods))


def overlap(combined: DataFrame) -> DataFrame:
    """Per query and document: which methods found it, and at which best rank."""
    return combined.groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("n_methods"),
        F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"),
        F.min("rank").alias("best_rank"),
    )


def rank_table(combined: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """One row per query and document with one rank column per method."""
    return combined.groupBy("query_id", "doc_id").pivot("method", list(methods)).agg(F.min("rank"))


def flagged(results: DataFrame, ids: DataFrame, batch: QueryBatch, name: str,
            rows_per_query: int = 10) -> DataFrame:
    """Add the flag ``name``: is the document in ``ids``, a table of ``doc_id``?

    The long table of ids is only streamed past the short list; what it leaves
    is no longer than the list itself.
    """
    short = batch.per_query(results.select("query_id", "doc_id"), rows_per_query)
    found = ids.select("doc_id").join(short, "doc_id").distinct().withColumn(name, F.lit(True))
    marked = results.join(batch.per_query(found, rows_per_query), ["query_id", "doc_id"], "left")
    return marked.withColumn(name, F.coalesce(name, F.lit(False)))


def hit_rate(combined: DataFrame, relevant: DataFrame, batch: QueryBatch,
             k: int = 10, rows_per_query: int = 40) -> DataFrame:
    """Per method: queries with results, queries with a relevant document in the first ``k``.

    ``relevant`` is a table of relevant ``doc_id``; it may be far larger than
    the result lists, which are the side that is broadcast when they fit.
    """
    listed = combined.filter(F.col("rank") <= k)
    hits = relevant.select("doc_id").join(
        batch.per_query(listed.select("method", "query_id", "doc_id"), rows_per_query), "doc_id"
    )
    hit_queries = hits.groupBy("method", "query_id").agg(F.count(F.lit(1)).alias("_n"))
    marked = combined.select("method", "query_id").distinct().join(
        batch.per_query(hit_queries, rows_per_query), ["method", "query_id"], "left"
    )
    return marked.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_answered"),
        F.count("_n").alias("n_hit"),
        (F.count("_n") / F.lit(batch.n_queries)).alias("hit_rate"),
    )
