"""Ranking: top rows per query, pages, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftwell.functions import scoring as sc


def ranked(df: DataFrame, score: str, descending: bool = True,
           tie: str = "doc_id", by: str = "query_id") -> DataFrame:
    """Add ``rank`` (1 is best) per query: score rounded to nine decimals, then id."""
    key = sc.rank_key(score)
    order = [key.desc() if descending else key.asc(), F.col(tie).asc()]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def top_k(df: DataFrame, k: int, score: str, descending: bool = True,
          tie: str = "doc_id", by: str = "query_id") -> DataFrame:
    """The ``k`` best rows per query.

    The filter directly above the window lets Spark keep only ``k`` rows per
    query and task before the exchange, so a query that matches a third of the
    corpus still sends ``k`` rows per task.
    """
    best = ranked(df, score, descending, tie, by).filter(F.col("rank") <= k)
    return best.withColumn("rank", F.col("rank").cast("long"))


def page(results: DataFrame, size: int = 5, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """First page of each result list and ``n_more``, the number of rows left out."""
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return (
        results.withColumn("_total", total)
        .filter(F.col("rank") <= size)
        .withColumn("n_more", F.greatest(F.col("_total") - size, F.lit(0)).cast("long"))
        .drop("_total")
    )


def any_in_top(results: DataFrame, n: int, predicate: Column, name: str,
               by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per query: does any of the first ``n`` rows satisfy the predicate?"""
    return results.filter(F.col("rank") <= n).groupBy(*by).agg(
        F.coalesce(F.bool_or(predicate), F.lit(False)).alias(name)
    )


def first_of_each(results: DataFrame, flag: Column, by: tuple[str, ...] = ("query_id",),
                  value: str = "score") -> DataFrame:
    """Per query, the best-ranked row with the flag and the best one without it."""
    return results.groupBy(*by).agg(
        F.min_by(F.when(flag, F.struct("doc_id", value)), F.when(flag, F.col("rank"))).alias("flagged"),
        F.min_by(F.when(~flag, F.struct("doc_id", value)), F.when(~flag, F.col("rank"))).alias("other"),
    )
