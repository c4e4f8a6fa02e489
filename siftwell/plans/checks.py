"""Validation jobs: properties of a corpus and its rankings as a table of checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as tx


def _check(df: DataFrame, name: str, passed: Column, details: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), details.alias("details")
    )


def union_checks(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n_checks")
    )


def corpus_checks(docs: DataFrame, phrase: str, needle: str, spam: Column,
                  min_docs: int, min_mass: int, min_topic: int) -> DataFrame:
    """Enough documents, a stuffed spam document, enough documents on the topic.

    All three come from one pass over the documents.
    """
    mass = tx.literal_count(F.lower("content"), F.lit(phrase))
    row = docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(F.when(spam, mass)), F.lit(0)).cast("long").alias("mass"),
        F.count_if(tx.has_substring("content", needle)).alias("topic"),
    )
    text = lambda c: F.col(c).cast("string")
    facts = F.array(
        F.struct(F.lit("corpus size").alias("name"), (F.col("n") >= min_docs).alias("passed"), text("n").alias("details")),
        F.struct(F.lit("keyword mass in spam").alias("name"), (F.col("mass") >= min_mass).alias("passed"), text("mass").alias("details")),
        F.struct(F.lit("topic coverage").alias("name"), (F.col("topic") >= min_topic).alias("passed"), text("topic").alias("details")),
    )
    return row.select(F.inline(facts))


def ranking_facts(scores: DataFrame, spam_ids: DataFrame) -> DataFrame:
    """Per query, in one pass over the full match table: match counts and spam ratios.

    The ratios compare the best spam score with the best other score, by term
    frequency and by BM25; NULL where a query has no match on one side.
    """
    spam = spam_ids.select("doc_id").distinct().withColumn("is_spam", F.lit(True))
    marked = scores.join(spam, "doc_id", "left")
    is_spam = F.col("is_spam").isNotNull()
    best = lambda value, flag: F.max(F.when(flag, F.col(value)))
    grouped = marked.groupBy("query_id").agg(
        F.count_if(F.col("n_matched") == F.col("n_terms")).alias("and_matches"),
        F.count_if(F.col("score") > 0).alias("bm25_matches"),
        best("tf_rank", is_spam).cast("double").alias("tf_spam"),
        best("tf_rank", ~is_spam).cast("double").alias("tf_other"),
        best("score", is_spam).alias("bm25_spam"),
        best("score", ~is_spam).alias("bm25_other"),
    )
    return grouped.select(
        "query_id", "and_matches", "bm25_matches",
        (F.col("tf_spam") / F.col("tf_other")).alias("tf_ratio"),
        (F.col("bm25_spam") / F.col("bm25_other")).alias("bm25_ratio"),
    )


def spam_ratio(scores: DataFrame, spam_ids: DataFrame) -> DataFrame:
    return ranking_facts(scores, spam_ids).select("query_id", "tf_ratio", "bm25_ratio")


def saturation_check(ratios: DataFrame) -> DataFrame:
    """Where spam leads by term frequency, it leads by less with BM25."""
    leads = ratios.filter((F.col("tf_ratio") > 1) & F.col("bm25_ratio").isNotNull())
    row = leads.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("bm25_ratio") < F.col("tf_ratio")).alias("smaller")
    )
    return _check(
        row, "saturation", F.col("smaller") == F.col("n"), F.format_string("%d of %d", "smaller", "n")
    )


def rare_term_check(results: DataFrame, has_rare_term: DataFrame, n: int = 3) -> DataFrame:
    """Share of queries with a document holding their rarest term among the first ``n``.

    ``has_rare_term`` lists ``query_id, doc_id`` of such documents.
    """
    top = results.filter(F.col("rank") <= n).select("query_id", "doc_id")
    found = has_rare_term.join(top, ["query_id", "doc_id"], "left_semi").select("query_id").distinct()
    asked = has_rare_term.select("query_id").distinct()
    row = asked.join(found.withColumn("_hit", F.lit(1)), "query_id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hit")
    )
    return _check(row, "rare terms on top", F.col("hit") == F.col("n"), F.format_string("%d of %d", "hit", "n"))


def short_document_check(results: DataFrame, docs: DataFrame, max_words: int, n: int = 2) -> DataFrame:
    """A document below ``max_words`` words among the first ``n`` of some query."""
    top = results.filter(F.col("rank") <= n)
    words = docs.select(F.col("id").alias("doc_id"), "word_count")
    row = words.join(top, "doc_id").agg(
        F.count_if(F.col("word_count") < max_words).alias("short"), F.count(F.lit(1)).alias("n")
    )
    return _check(row, "short documents compete", F.col("short") > 0, F.format_string("%d of %d", "short", "n"))


def more_matches_check(counts: DataFrame) -> DataFrame:
    """Ranked retrieval finds at least as much as AND for every query, more in total."""
    row = counts.agg(
        F.coalesce(F.sum("and_matches"), F.lit(0)).alias("a"), F.coalesce(F.sum("bm25_matches"), F.lit(0)).alias("b"),
        F.count_if(F.col("bm25_matches") < F.col("and_matches")).alias("worse"),
    )
    return _check(
        row, "ranked finds more", (F.col("b") > F.col("a")) & (F.col("worse") == 0),
        F.format_string("BM25 %d, AND %d", "b", "a"),
    )


def embedding_check(docs: DataFrame, dims: int) -> DataFrame:
    """Post-load: every document counted, vectors present and of one dimension."""
    row = docs.agg(
        F.count(F.lit(1)).alias("n"), F.count("embedding").alias("e"),
        F.count_if(F.size("embedding") != dims).alias("wrong"),
    )
    return _check(
        row, "embeddings loaded", (F.col("e") > 0) & (F.col("wrong") == 0),
        F.format_string("%d of %d", "e", "n"),
    )
