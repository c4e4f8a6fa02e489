"""Shards by measured size."""

from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.operators.index import save_index
from siftwell.sources import documents as src
from workload import tables


def test_shards_grow_with_rows_and_text_not_with_splits(spark):
    rows = spark.range(0, 75_000, 1, 1).select("id", F.lit("short").alias("text"))
    assert rows.rdd.getNumPartitions() == 1
    assert runtime.default_shards(rows, "text") == 8
    long = spark.range(0, 10, 1, 1).select("id", F.repeat(F.lit("x"), 16 << 20).alias("text"))
    assert runtime.default_shards(long, "text") == 10
    many = spark.range(0, 10, 1, 1).select("id", F.lit(None).cast("string").alias("text"))
    assert runtime.default_shards(many, "text") == spark.sparkContext.defaultParallelism


def test_a_task_of_an_index_has_one_shard(spark):
    """However few splits the documents would make, a task reads one bucket and writes no file of another."""
    home = runtime.scratch_path(spark, "one-shard")
    docs = src.inline_documents(spark, [(i, "t", f"w{i} x", "c") for i in range(300)]).drop("embedding")
    docs = src.write_documents(docs, f"{home}/docs", "one_shard_docs", 24)
    index = save_index(docs, f"{home}/index", "one_shard_index", term_buckets=1, shards=24)
    tasks = index.postings.select(F.regexp_extract("_metadata.file_name", r"part-(\d+)-", 1).alias("task"), "_metadata.file_name")
    found = tasks.groupBy("task").agg(F.count_distinct("file_name").alias("n")).collect()
    assert len(found) == 24 and {r["n"] for r in found} == {1}
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"


def test_text_is_shuffled_once_on_its_way_to_the_documents(spark, tmp_path, monkeypatch):
    """The vectors are dealt out like the documents, also where a session has more shuffle partitions than shards."""
    spark.range(40).selectExpr("id AS doc_id", "concat('title ', id, '\\n text') AS text", "'s' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(20).selectExpr("id AS vec_id", "array(1.0f, 2.0f) AS embedding", "id % 10 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(tables, "_OPEN", {})
    texts = []

    def written(docs, path, name, shards):
        texts.append(docs.repartition(shards, "id")._jdf.queryExecution().executedPlan().toString())
        return docs

    monkeypatch.setattr(src, "write_documents", written)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        docs = tables.corpus(spark, str(tmp_path)).documents()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    exchanges = [line for line in texts[0].splitlines() if "Exchange" in line]
    assert len(exchanges) == 2  # texts, vectors
    assert docs.filter("embedding IS NOT NULL").count() == 20 and docs.count() == 40
