"""Substring search by trigrams: a table of postings names the documents that a search has to read.

Every text is cut into its distinct sequences of three characters, lower-cased. A document
that contains a needle of three or more characters holds all of the needle's trigrams, so
only documents that do are read and tested. A shorter needle has none; every document is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import text as tx

#: Characters of a gram, folders of the table, bytes of an id in a broadcast relation.
GRAM, BUCKETS, ID_BYTES = 3, 64, 64
#: Ids that are handed to the reader, which skips the parts of files that have none of them.
PUSHED_IDS = 500


@dataclass(frozen=True)
class TrigramIndex:
    postings: DataFrame  # gram_bucket, gram, doc_id
    column: str
    id_column: str


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text."""
    def cut(chars: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(chars) - GRAM)
        joined = F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)]))
        return F.when(F.size(chars) >= GRAM, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))

    return tx.let(F.split(text, ""), cut)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def save_trigrams(docs: DataFrame, path: str, column: str = "content", id_column: str = "id") -> TrigramIndex:
    """Write the postings of a text column; a text is cut where it lies, and nothing but its grams moves."""
    rows = docs.select(F.col(id_column).alias("doc_id"), grams(F.lower(F.col(column))).alias("g")).select("doc_id", F.explode("g").alias("gram"))
    rows = rows.withColumn("gram_bucket", _bucket(F.col("gram")))
    (
        rows.hint("rebalance", "gram_bucket").sortWithinPartitions("gram_bucket", "gram")
        .write.mode("overwrite").partitionBy("gram_bucket").parquet(f"{path}/trigrams")
    )
    return load_trigrams(docs.sparkSession, path, column, id_column)


def load_trigrams(spark: SparkSession, path: str, column: str = "content", id_column: str = "id") -> TrigramIndex:
    kind = "doc_id long, gram string, gram_bucket int"
    return TrigramIndex(spark.read.schema(kind).parquet(f"{path}/trigrams"), column, id_column)


def candidates(index: TrigramIndex, needle: str) -> DataFrame | None:
    """``doc_id`` of the documents that hold all trigrams of the needle; None where it has none."""
    spark = index.postings.sparkSession
    wanted = spark.range(1).select(F.explode(grams(F.lower(F.lit(needle)))).alias("gram")).select("gram", _bucket(F.col("gram")).alias("b")).collect()
    if not wanted:
        return None
    # At most one value for each character of the needle; the buckets prune the folders.
    held = index.postings.filter(F.col("gram_bucket").isin(sorted({r["b"] for r in wanted})) & F.col("gram").isin([r["gram"] for r in wanted]))
    return held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("doc_id")


def containing(docs: DataFrame, index: TrigramIndex, needle: str) -> DataFrame:
    """The rows of ``docs`` whose indexed column contains ``needle``, without regard to letter case.

    ``docs`` must be the documents of the index. Nulls contain nothing, an empty needle is in every text.
    """
    test = tx.has_substring(index.column, needle.lower())
    found = candidates(index, needle)
    if found is None:
        return docs.filter(test)
    found = runtime.write_scratch(found, "substring-candidates")
    n = found.count()
    if n <= PUSHED_IDS:
        # Documents are sorted by id, so the reader leaves out the row groups and pages without one of them.
        return docs.filter(F.col(index.id_column).isin([r[0] for r in found.collect()])).filter(test)
    side = F.broadcast(found) if n * ID_BYTES <= runtime.BROADCAST_BYTES else found
    return docs.join(side.withColumnRenamed("doc_id", index.id_column), index.id_column, "left_semi").filter(test)
