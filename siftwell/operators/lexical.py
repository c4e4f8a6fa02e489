"""Boolean and BM25 retrieval for a whole table of queries at once."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import scoring as sc
from siftwell.operators import grid, topk
from siftwell.operators.batch import QueryBatch
from siftwell.operators.index import LexicalIndex, join_postings, look_up_terms

# Fixed value: queries for which a task may hold a score for each document of its shard.
MOST_QUERIES = 500


def match_scores(index: LexicalIndex, batch: QueryBatch, k1: float = sc.K1, b: float = sc.B,
                 within: DataFrame | None = None) -> DataFrame:
    """Every (query, document) pair that shares a term, with all lexical measures.

    ``n_matched`` / ``n_terms`` decide boolean AND and OR, ``tf_rank`` is the
    plain term-frequency rank and ``score`` is BM25. One join and one aggregate
    serve all of them. On a saved index the aggregate needs no exchange,
    because the postings are bucketed by document. ``within`` (a table of
    ``doc_id``, e.g. of documents that pass a LIKE filter) restricts the
    documents; term statistics stay those of the whole corpus. Postings that lie in
    several tables are added up table by table, as each holds its documents whole.
    """
    if index.parts:
        each = [match_scores(replace(index, postings=p, parts=()), batch, k1, b, within) for p in index.parts]
        return reduce(DataFrame.unionByName, each)
    terms = look_up_terms(index, batch.query_terms(index.analyzer), batch).select(
        "term_bucket", "term", "query_id", "n_terms", "idf"
    )
    hits = join_postings(index, terms, batch)
    if within is not None:
        # An inner join, because a semi-join would be moved below the term join
        # and test every posting instead of the few that matched a term.
        hits = hits.join(within.select("doc_id").distinct(), "doc_id")
    part = sc.bm25_term(F.col("idf"), F.col("tf"), F.col("doc_len"), index.avg_len(), k1, b)
    return hits.groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.max("n_terms").alias("n_terms"),
        F.sum("tf").alias("tf_rank"),
        F.sum(part).alias("score"),
    )


def match_all(scores: DataFrame) -> DataFrame:
    """Boolean AND: every distinct term of the query occurs."""
    return scores.filter(F.col("n_matched") == F.col("n_terms"))


def match_any(scores: DataFrame) -> DataFrame:
    """Boolean OR: at least one term occurs."""
    return scores.filter(F.col("n_matched") >= 1)


def boolean_topk(scores: DataFrame, k: int = 10) -> DataFrame:
    """Documents that contain all terms, ordered by term frequency."""
    found = match_all(scores).select("query_id", "doc_id", F.col("tf_rank").cast("double").alias("score"))
    return topk.top_k(found, k, "score")


def bm25_topk(scores: DataFrame, k: int = 10) -> DataFrame:
    found = scores.filter(F.col("score") > 0).select("query_id", "doc_id", "score")
    return topk.top_k(found, k, "score")


def bm25_best(index: LexicalIndex, batch: QueryBatch, k: int = 10) -> DataFrame:
    """The list of :func:`bm25_topk` for a batch of any size.

    The score table has a row per query and matching document; for more queries than
    MOST_QUERIES it is made block by block instead, one query at a time.
    """
    if batch.n_queries > MOST_QUERIES:
        return grid.bm25_topk_on_grid(index, batch, k)
    return bm25_topk(match_scores(index, batch), k)


def ranked_lists(scores: DataFrame, k: int = 10) -> DataFrame:
    """The boolean and the BM25 list in one pass over the matches.

    ``method, query_id, doc_id, score, rank``: a match is ranked by BM25, and by
    term frequency as well where it holds every term.
    """
    bm25 = F.struct(F.lit("bm25").alias("method"), F.col("score").alias("s"))
    boolean = F.when(
        F.col("n_matched") == F.col("n_terms"),
        F.struct(F.lit("boolean").alias("method"), F.col("tf_rank").cast("double").alias("s")),
    )
    both = scores.filter(F.col("score") > 0).select(
        "query_id", "doc_id", F.explode(F.array(bm25, boolean)).alias("e")
    ).filter(F.col("e").isNotNull())
    rows = both.select(
        F.struct("query_id", "e.method").alias("_list"), "doc_id", F.col("e.s").alias("score")
    )
    best = topk.top_k(rows, k, "score", by="_list")
    return best.select("_list.method", "_list.query_id", "doc_id", "score", "rank")


def bm25_topk_above(scores: DataFrame, batch: QueryBatch, k: int = 10) -> DataFrame:
    """BM25 with the query's own threshold: strictly above, where one is set.

    The best ``k`` rows above a score are those of the best ``k`` rows that lie
    above it, so the threshold is applied to the short list.
    """
    return batch.apply_threshold(bm25_topk(scores, k), F.col("score") > F.col("threshold"))


def match_counts(scores: DataFrame, batch: QueryBatch) -> DataFrame:
    """Per query: how many documents match by AND and how many by BM25."""
    counted = scores.groupBy("query_id").agg(
        F.count_if(F.col("n_matched") == F.col("n_terms")).alias("and_matches"),
        F.count_if(F.col("score") > 0).alias("bm25_matches"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return batch.queries.select("query_id").join(counted, "query_id", "left").select(
        "query_id", zero("and_matches"), zero("bm25_matches")
    )
