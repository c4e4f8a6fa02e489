"""Why a document was found: matched terms, rarity, length, ranks, marked text.

All functions work on short result lists: ranking runs on ids alone and the
text is attached afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import scoring as sc
from siftwell.functions import text as tx
from siftwell.operators.analyze import Analyzer, with_terms
from siftwell.operators.batch import QueryBatch
from siftwell.operators.index import LexicalIndex, join_postings, look_up_terms, term_bucket

# The texts of the explanations.
ALL_TERMS = "✓ Contains ALL %d query terms"
SOME_TERMS = "Contains %d/%d terms"
NO_DIRECT_TERMS = "No direct term matches (scored by related terms)"
MATCHED_TERMS = "Matched %d/%d terms"
IDF_BOOST = "IDF boost from: "
NO_BOOST = "none"
LOW_RELEVANCE = "Low relevance score"
SIMILARITY = "%s semantic similarity (%d%%)"
BY_BOTH = "Found by BOTH: Vector #%d + Keyword #%d"
BY_VECTOR = "Found by VECTOR only: #%d"
BY_KEYWORD = "Found by KEYWORD only: #%d"
RRF_WEIGHTS = "RRF combines ranks: (%s×vector) + (%s×keyword)"


# -- attaching text ----------------------------------------------------------


def with_documents(results: DataFrame, docs: DataFrame, batch: QueryBatch,
                   rows_per_query: int = 10) -> DataFrame:
    """Add ``title, content, category, word_count, full_text`` to a result list.

    The list has at most ``rows_per_query`` rows per query. While that fits the
    broadcast limit the documents are streamed without a shuffle; beyond it
    both sides are shuffled by id, where adaptive execution splits the rows of
    a document that is a result of very many queries.
    """
    texts = docs.select(
        F.col("id").alias("doc_id"), "title", "content", "category", "word_count", "full_text"
    )
    return texts.join(batch.per_query(results, rows_per_query, bytes_per_row=256), "doc_id")


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows with text out evenly before their text is analyzed.

    A document that is a result of very many queries would otherwise be
    analyzed for all of them in the one task that read it.
    """
    return rows.repartition("query_id", "doc_id")


def with_query_terms(results: DataFrame, batch: QueryBatch) -> DataFrame:
    """Echo the query: ``query``, its display ``terms``, the ``threshold`` that counts."""
    side = batch.queries.select(
        "query_id", "query", tx.display_terms("query").alias("terms"),
        F.when(F.col("threshold") > 0, F.col("threshold")).alias("threshold"),
    )
    return results.join(batch.text_side(side), "query_id")


# -- term matches ------------------------------------------------------------


def match_terms(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``matched_terms, missing_terms, term_counts`` for ``terms`` against ``text``.

    Matching is by substring and counts are literal occurrences, both without
    regard to letter case; duplicates of a query term stay in the lists.
    """
    distinct = F.array_distinct("terms")
    # Each text is lower-cased and searched once for each term; the counts say which terms match.
    counts = tx.let(F.lower(text), lambda t: F.transform(distinct, lambda w: tx.literal_count(t, w)))
    counted = rows.withColumn("term_counts", F.map_from_arrays(distinct, counts))
    n = lambda w: F.col("term_counts")[w]
    return counted.select(
        *rows.columns, F.filter("terms", lambda w: n(w) > 0).alias("matched_terms"),
        F.filter("terms", lambda w: n(w) == 0).alias("missing_terms"), "term_counts",
    )


# -- term statistics of the displayed terms ----------------------------------


def _compound_frequencies(index: LexicalIndex, docs: DataFrame, terms: DataFrame,
                          batch: QueryBatch) -> DataFrame:
    """Document frequency of terms such as ``pg-1234``: whole-word, literal.

    The index yields the documents that hold all parts; only those are checked
    against their text. Their number is measured before it decides the join.
    """
    split = F.array_distinct(tx.tokens("term"))
    parts = terms.select(
        F.col("term").alias("compound"), F.size(split).alias("n_parts"), F.explode(split).alias("term")
    ).withColumn("term_bucket", term_bucket(index.term_buckets))
    holders = (
        join_postings(index, parts, batch).groupBy("compound", "n_parts", "doc_id")
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("n_parts"))
    )
    candidates = runtime.write_scratch(holders.select("compound", "doc_id"), "compound-candidates")
    rows, size = candidates.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("compound")), F.lit(0))
    ).first()
    side = F.broadcast(candidates) if batch.fits(rows, size) else candidates
    texts = docs.select(F.col("id").alias("doc_id"), "full_text")
    checked = texts.join(side, "doc_id").filter(tx.has_whole_word("full_text", F.col("compound")))
    return checked.groupBy(F.col("compound").alias("term")).agg(F.count(F.lit(1)).alias("doc_freq"))


def display_term_stats(index: LexicalIndex, docs: DataFrame, batch: QueryBatch) -> DataFrame:
    """``term, doc_freq, idf`` for every distinct display term of the batch.

    Document frequency is by whole word, taken literally. A term of plain word
    characters is looked up in the ``simple`` index; a term that begins or ends
    in another character has no word boundary there and matches nothing.
    """
    shown = batch.queries.select(
        F.explode_outer(F.array_distinct(tx.display_terms("query"))).alias("term")
    ).filter(F.col("term").isNotNull()).distinct()
    counted = look_up_terms(index, shown, batch).select("term", "doc_freq")
    if batch.n_compounds:
        compounds = shown.filter(tx.is_compound(F.col("term")))
        counted = counted.unionByName(_compound_frequencies(index, docs, compounds, batch))
    side = F.broadcast(counted) if batch.terms_fit() else counted
    freq = F.coalesce(F.col("doc_freq"), F.lit(0)).cast("long")
    return shown.join(side, "term", "left").select(
        "term", freq.alias("doc_freq"), sc.idf(index.n_docs(), freq).alias("idf")
    )


def rare_term_flags(stats: DataFrame, n_docs: Column, rare: int = sc.HIGH_DF) -> DataFrame:
    """Add ``is_rare`` and the text shown for a term, ``term (df/N)``."""
    return stats.select(
        "*", (F.col("doc_freq") <= rare).alias("is_rare"),
        F.format_string("%s (%d/%d)", F.col("term"), F.col("doc_freq"), n_docs).alias("shown_as"),
    )


def stats_by_query(stats: DataFrame, batch: QueryBatch) -> DataFrame:
    """``query_id, term_stats``: a map from display term to its statistics.

    One map per query, no larger than the query text itself.
    """
    shown = batch.queries.select(
        "query_id", F.explode(F.array_distinct(tx.display_terms("query"))).alias("term")
    )
    side = F.broadcast(stats) if batch.terms_fit() else stats
    entry = F.struct("term", F.struct("doc_freq", "idf"))
    return shown.join(side, "term").groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("term_stats")
    )


def contributions(rows: DataFrame, stats: DataFrame, batch: QueryBatch,
                  high: int = sc.HIGH_DF, medium: int = sc.MEDIUM_DF) -> DataFrame:
    """Add ``contributions``: per present query term its count, rarity and level."""
    side = batch.text_side(stats_by_query(stats, batch))
    joined = rows.join(side, "query_id", "left")
    present = F.filter("terms", lambda t: F.col("term_counts")[t] > 0)

    def describe(t: Column) -> Column:
        s = F.col("term_stats")[t]
        return F.struct(
            t.alias("term"), F.col("term_counts")[t].alias("count"),
            s["idf"].alias("idf"), s["doc_freq"].alias("doc_freq"),
            sc.rarity_level(s["doc_freq"], high, medium).alias("level"),
        )

    return joined.withColumn("contributions", F.transform(present, describe)).drop("term_stats")


# -- reasons -----------------------------------------------------------------


def _share(template: str) -> Column:
    return F.format_string(template, F.size("matched_terms"), F.size("terms"))


def explain_boolean(rows: DataFrame) -> DataFrame:
    all_found = F.size("matched_terms") == F.size("terms")
    return rows.select(
        "*",
        F.when(all_found, F.format_string(ALL_TERMS, F.size("terms")))
        .otherwise(_share(SOME_TERMS)).alias("reason"),
        F.lit("term frequency only (no IDF weighting)").alias("why_ranked"),
    )


def explain_bm25(rows: DataFrame, avg_length: float = sc.LABEL_AVG_LENGTH) -> DataFrame:
    """Needs ``contributions``; adds ``length_factor, reason, why_ranked``."""
    high = F.filter("contributions", lambda c: c["level"] == "HIGH")
    names = F.array_join(F.transform(high, lambda c: c["term"]), ", ")
    boosted = F.concat(
        F.lit(IDF_BOOST), F.when(F.size(high) > 0, names).otherwise(NO_BOOST)
    )
    return rows.select(
        "*",
        sc.length_factor(F.col("word_count"), avg_length).alias("length_factor"),
        F.when(F.size("matched_terms") == 0, NO_DIRECT_TERMS)
        .otherwise(_share(MATCHED_TERMS)).alias("reason"),
        F.when(F.size("contributions") > 0, boosted).otherwise(LOW_RELEVANCE).alias("why_ranked"),
    )


def explain_vector(rows: DataFrame, high: float = sc.HIGH_SIMILARITY,
                   moderate: float = sc.MODERATE_SIMILARITY) -> DataFrame:
    percent = F.round(F.col("similarity") * 100).cast("int")
    return rows.select(
        "*",
        F.format_string(
            SIMILARITY,
            sc.similarity_class(F.col("similarity"), high, moderate), percent,
        ).alias("reason"),
        F.lit("embedding cosine similarity").alias("why_ranked"),
    )


def explain_hybrid(rows: DataFrame) -> DataFrame:
    v, k = F.col("vector_rank"), F.col("keyword_rank")
    return rows.select(
        "*",
        F.when(v.isNotNull() & k.isNotNull(),
               F.format_string(BY_BOTH, v, k))
        .when(v.isNotNull(), F.format_string(BY_VECTOR, v))
        .otherwise(F.format_string(BY_KEYWORD, k)).alias("reason"),
        F.format_string(
            RRF_WEIGHTS,
            F.col("vector_weight").cast("string"), F.col("keyword_weight").cast("string"),
        ).alias("why_ranked"),
    )


def first_terms(rows: DataFrame, matched: int = 3, missing: int = 2) -> DataFrame:
    """The few terms shown next to a result."""
    return rows.select(
        "*", F.slice("matched_terms", 1, matched).alias("shown_matched"),
        F.slice("missing_terms", 1, missing).alias("shown_missing"),
    )


# -- marked text -------------------------------------------------------------


def headline(rows: DataFrame, batch: QueryBatch, analyzer: Analyzer = Analyzer(),
             max_words: int = 50, min_words: int = 20) -> DataFrame:
    """Add ``headline``: the part of ``content`` with most query words, words marked.

    A query word is any word one of whose analyzed terms is a term of the query.
    Without such a word the first ``min_words`` words are shown.
    """
    query_rows = batch.queries.select(
        "query_id", *([analyzer.lang_column] if analyzer.lang_column else []),
        analyzer.terms("query").alias("_wanted"),
    ).select("query_id", "_wanted")
    joined = rows.join(batch.text_side(query_rows), "query_id")
    plain = tx.tokens_with_compounds if analyzer.keep_compounds else tx.tokens
    surfaces = joined.withColumn("_surface", F.array_distinct(plain("content")))
    analyzed = _analyze_tokens(surfaces, analyzer)
    kept = tx.let(
        F.col("_wanted"),
        lambda wanted: F.filter(
            F.arrays_zip(F.col("_surface").alias("s"), F.col("_analyzed").alias("a")),
            lambda p: F.coalesce(F.array_contains(wanted, p["a"]), F.lit(False)),
        ),
    )
    words = F.filter(F.split("content", tx.SPACES), lambda w: w != "")
    prepared = analyzed.withColumn("_words", words).withColumn("_hit_terms", F.transform(kept, lambda p: p["s"]))
    located = prepared.withColumn("_hits", tx.hit_positions("_words", "_hit_terms"))
    length = F.when(F.size("_hits") > 0, max_words).otherwise(min_words)
    placed = located.withColumn(
        "_start", tx.best_window_start("_hits", F.size("_words"), max_words, min_words)
    ).withColumn("_length", length)
    marked = placed.withColumn("headline", tx.mark_window("_words", "_hits", "_start", "_length"))
    return marked.select(*rows.columns, "headline")


def _analyze_tokens(rows: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Add ``_analyzed``: the term of each surface token, NULL for a stop word."""
    if analyzer.config == "simple":
        return rows.withColumn("_analyzed", F.col("_surface"))
    return rows.withColumn("_analyzed", analyzer.reduce(F.col("_surface")))
