"""From raw documents to token ids in five stages.

Each stage takes the documents its predecessor kept, decides about all of them, and
its decisions take effect: rejected documents go, deleted lines are gone from the
text. All stages but the last return the columns of documents, other columns
included. Rows without a doc_id are neither copies nor contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.llm import jaccard, lines, pieces, positional, quality

#: A document stays if its score is at least this.
LEAST_QUALITY = 0.5
#: Ids of removed documents that are broadcast at most; above, the removal is a shuffled join.
BROADCAST_IDS = 4_000_000


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in the one column of ``ids``."""
    ids = runtime.write_scratch(ids.toDF("gone").distinct(), "gone")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, docs["doc_id"] == side["gone"], "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier, fitted on labelled rows, rejects. A null or empty text has the score of a neutral one."""
    model = quality.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _unused(docs, "quality_score")
    return quality.score_quality(docs, model, into=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks of lines that an earlier document has. A document that loses all its lines goes."""
    found = _unused(docs, "deduped")
    out = lines.dedup_lines(docs, into=found)
    text, cut = F.col(f"{found}.text"), F.col(f"{found}.n_removed") > 0
    out = out.filter(~(cut & (F.trim(text) == "")))
    new = {"text": text, "n_chars": F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets keep the one with the smallest doc_id; of rows that repeat it, one."""
    found = runtime.write_scratch(jaccard.jaccard_components(docs), "groups")
    if found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").limit(1).count():
        known = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
        docs = known.unionByName(docs.filter("doc_id is null"))
    return _without(docs, found.filter("doc_id <> component_id").select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = positional.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated and doc_id is not null").select("doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): the ids of every text; null and empty texts have none."""
    ids = pieces.encoder(docs, pieces.load_model())(F.coalesce(F.col("text"), F.lit("")))
    out = docs.select("doc_id", "lang", "source", ids.alias("ids"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", cut_lines),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

# A trained classifier and a tokenizer have no SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = runtime.write_scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
