"""Inverted index as ordinary tables.

``define_index`` describes the tables lazily over a corpus: enough for one bulk
run, which then reads the text once and never shuffles it.  ``save_index``
writes them for many runs:

* ``postings``   one row per (term, document), partitioned by ``term_bucket``
                 so that a run reads only the buckets of its terms, and
                 bucketed by ``doc_id`` so that the scores of a document add up
                 inside one task.  Bucketing by document also spreads a term
                 that occurs in a third of all documents over every bucket.
* ``term_stats`` one row per term with its document frequency and IDF.
* ``corpus_stats`` one row: number of documents, tokens, mean length.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import scoring as sc
from siftwell.operators.analyze import Analyzer, entries_in_row, with_terms
from siftwell.operators.batch import QueryBatch

# Fixed value: a term is hot when it holds more than this fraction of all
# postings; there can be at most its inverse of such terms.
HOT_FRACTION = 1e-4


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame       # term_bucket, term, doc_id, tf, doc_len, positions
    term_stats: DataFrame     # term_bucket, term, doc_freq, idf
    corpus_stats: DataFrame   # n_docs, n_tokens, avg_len (one row)
    analyzer: Analyzer
    term_buckets: int
    saved: bool = True
    parts: tuple[DataFrame, ...] = ()   # the postings in tables that share no document, if they lie in several

    def n_docs(self):
        """Number of documents as a scalar subquery."""
        return self.corpus_stats.select("n_docs").scalar()

    def avg_len(self):
        return self.corpus_stats.select("avg_len").scalar()


def term_bucket(n: int):
    return F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")


def define_index(docs: DataFrame, analyzer: Analyzer = Analyzer(), text_column: str = "full_text",
                 id_column: str = "id", term_buckets: int = 16) -> LexicalIndex:
    """The index of ``docs`` as lazy tables over the analyzed corpus."""
    keep = [F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text")]
    if analyzer.lang_column:
        keep.append(F.col(analyzer.lang_column))
    analyzed = with_terms(docs.select(*keep), "_text", analyzer).select("doc_id", "terms")
    postings = entries_in_row(analyzed).select(
        term_bucket(term_buckets).alias("term_bucket"), "term", "doc_id", "tf", "doc_len", "positions"
    )
    kept = F.filter("terms", lambda t: t.isNotNull())
    corpus = _corpus_stats(
        analyzed.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(kept)).alias("n_tokens"))
    )
    return LexicalIndex(postings, _term_stats(postings, corpus), corpus, analyzer, term_buckets, saved=False)


def _corpus_stats(counts: DataFrame) -> DataFrame:
    tokens = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    return counts.select(
        "n_docs", tokens.alias("n_tokens"),
        (tokens / F.col("n_docs")).alias("avg_len"),
    )


def _term_stats(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    counted = postings.groupBy("term_bucket", "term").agg(F.count(F.lit(1)).alias("doc_freq"))
    n_docs = corpus.select("n_docs").scalar()
    return counted.withColumn("idf", sc.idf(n_docs, F.col("doc_freq")))


def save_index(docs: DataFrame, path: str, name: str, analyzer: Analyzer = Analyzer(),
               text_column: str = "full_text", id_column: str = "id",
               term_buckets: int = 16, shards: int | None = None) -> LexicalIndex:
    """Build and write the index below ``path``; ``name`` is its catalog name.

    At most one exchange happens, on the raw rows by document id, and none when
    ``docs`` is already bucketed so.  After it every task tokenizes its
    documents, sorts its own postings and writes one file per term bucket.  The statistics then come from narrow column scans of the
    written postings.
    """
    spark = docs.sparkSession
    shards = shards or runtime.default_shards(docs, text_column)
    carried = [id_column, text_column] + ([analyzer.lang_column] if analyzer.lang_column else [])
    spread = docs.select(*carried).repartition(shards, id_column)
    lazy = define_index(spread, analyzer, text_column, id_column, term_buckets)
    runtime.forget_table(spark, name)
    with runtime.bucket_by_bucket(spark):
        (
            lazy.postings.write.mode("overwrite").format("parquet")
            .partitionBy("term_bucket").bucketBy(shards, "doc_id").sortBy("term")
            .option("path", f"{path}/postings").option("compression", runtime.CODEC).saveAsTable(name)
        )
    postings = spark.table(name)
    counts = postings.agg(F.sum("tf").alias("n_tokens")).withColumn(
        "n_docs", docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    )
    _corpus_stats(counts).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    corpus = spark.read.parquet(f"{path}/corpus_stats")
    (
        _term_stats(postings, corpus)
        .hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term")
        .write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/term_stats")
    )
    return LexicalIndex(postings, spark.read.parquet(f"{path}/term_stats"), corpus, analyzer, term_buckets)


def load_index(spark: SparkSession, path: str, name: str, shards: int,
               analyzer: Analyzer = Analyzer(), term_buckets: int = 16) -> LexicalIndex:
    """Register an index written by another application and open it.

    ``shards``, ``term_buckets`` and ``analyzer`` must be those it was built with.
    """
    runtime.forget_table(spark, name)
    spark.sql(
        f"CREATE TABLE `{name}` (term STRING, doc_id BIGINT, tf BIGINT, doc_len BIGINT, "
        f"positions ARRAY<INT>, term_bucket INT) USING parquet "
        f"PARTITIONED BY (term_bucket) CLUSTERED BY (doc_id) SORTED BY (term) "
        f"INTO {shards} BUCKETS LOCATION '{path}/postings'"
    )
    spark.catalog.recoverPartitions(name)
    return LexicalIndex(
        spark.table(name),
        spark.read.parquet(f"{path}/term_stats"),
        spark.read.parquet(f"{path}/corpus_stats"),
        analyzer, term_buckets,
    )


def doc_lengths(docs: DataFrame, analyzer: Analyzer = Analyzer(),
                text_column: str = "full_text", id_column: str = "id") -> DataFrame:
    """``doc_id, doc_len`` for every document, including those without any term."""
    kept = F.filter("terms", lambda t: t.isNotNull())
    return with_terms(docs, text_column, analyzer).select(
        F.col(id_column).alias("doc_id"), F.size(kept).cast("long").alias("doc_len")
    )


def prune_common(index: LexicalIndex, max_df_ratio: float) -> LexicalIndex:
    """Leave out terms that occur in more than this share of the documents.

    Changes scores; meant for ``simple`` indexes, which have no stop words.
    """
    limit = index.n_docs() * F.lit(max_df_ratio)
    return replace(index, term_stats=index.term_stats.filter(F.col("doc_freq") <= limit))


def look_up_terms(index: LexicalIndex, terms: DataFrame, batch: QueryBatch) -> DataFrame:
    """Join ``terms`` (any table with a ``term`` column) to its statistics.

    Terms that occur nowhere are dropped. On a lazy index a semi-join comes
    first: it moves below the count, so that only the terms asked for are counted.
    """
    keys = ["term_bucket", "term"]
    fits = F.broadcast if batch.terms_fit() else (lambda df: df)
    keyed = terms.withColumn("term_bucket", term_bucket(index.term_buckets))
    stats = index.term_stats
    if not index.saved:
        stats = stats.join(fits(keyed.select(*keys).distinct()), keys, "left_semi")
    return stats.join(fits(keyed), keys)


def join_postings(index: LexicalIndex, weighted_terms: DataFrame, batch: QueryBatch) -> DataFrame:
    """Query terms to postings.

    The query side is broadcast when its measured size allows it; the postings
    then stay where they lie. Otherwise both sides are shuffled by term, with
    every hot term split over as many salts as keep a piece at HOT_FRACTION of
    all postings. There can be at most 1 / HOT_FRACTION hot terms, so that
    table is small enough to broadcast by construction. A term that is common
    among the queries but rare in the corpus is left to the skew handling of
    adaptive execution.
    """
    postings = index.postings.drop("positions")
    keys = ["term_bucket", "term"]
    if batch.terms_fit():
        return postings.join(F.broadcast(weighted_terms), keys)
    piece = index.term_stats.agg(F.sum("doc_freq")).scalar() * F.lit(HOT_FRACTION)
    hot = F.broadcast(
        index.term_stats.filter(F.col("doc_freq") > piece)
        .select(*keys, F.ceil(F.col("doc_freq") / piece).cast("int").alias("n_salts"))
    )
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("n_salts")).cast("int"), F.lit(0))
    salts = F.sequence(F.lit(0), F.coalesce(F.col("n_salts"), F.lit(1)) - 1)
    left = postings.join(hot, keys, "left").withColumn("salt", salt).drop("n_salts")
    right = weighted_terms.join(hot, keys, "left").withColumn("salt", F.explode(salts)).drop("n_salts")
    return left.join(right, [*keys, "salt"]).drop("salt")
