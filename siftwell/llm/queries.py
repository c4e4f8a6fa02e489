"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import angles, forest, jaccard, kneser_ney, language, lines, pages, pieces, positional, quality, sharding, shared_terms, toxicity, training

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.vector_links(table(spark, sf_dir, "embeddings"))


@query
def op2_language_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict_language(docs, language.language_model(docs))
    return found.select("doc_id", training.held_out("doc_id", 5, 0).alias("held_out"), "language.lang_pred", "language.score")


@query
def op3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


@query
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = training.held_out("doc_id", 10, 0)
    model = kneser_ney.fit_model(docs.filter(~held))
    return kneser_ney.score_texts(docs, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


@query
def op5_benchmark_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pieces.digest(docs, pieces.load_model()).alias("d")).select("doc_id", "d.*")


@query
def op8_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", training.held_out("doc_id", 5, 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("deduped.text", F.lit(""))
    return found.select(
        "doc_id", "deduped.n_lines", "deduped.n_removed", "deduped.removed_words",
        F.octet_length(text).cast("long").alias("kept_bytes"), F.crc32(text).alias("text_crc32"),
    )


@query
def op10_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", training.held_out("doc_id", 3, 1).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op11_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_terms.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query
def op12_angle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return angles.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query
def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
