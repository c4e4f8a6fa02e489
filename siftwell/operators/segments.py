"""Changes of documents without rewriting the documents or the index.

Documents lie in shards by a hash of their id, and a change rewrites only the shards it
touches. An index keeps its base as it is: every round of changes adds a segment with the
postings of new and changed documents, the ids whose earlier postings no longer
count, and the signed changes of the statistics. A reader merges them; the result is an
ordinary index. Segments can be folded into one, which reads the changes only.

A segment counts once its last file, the note that it is complete, is there; what a failed
attempt left is overwritten by the next.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.functions import scoring as sc
from siftwell.operators.index import LexicalIndex, define_index

#: Bytes of an id in a broadcast relation.
ID_BYTES = 64


def _small(df: DataFrame) -> DataFrame:
    """Mark a table of ids for broadcast if its counted size allows it."""
    return F.broadcast(df) if df.count() * ID_BYTES <= runtime.BROADCAST_BYTES else df


# -- documents -----------------------------------------------------------------


def shard_of(key: Column | str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def write_sharded(docs: DataFrame, path: str, shards: int, key: str = "id") -> DataFrame:
    """Write documents into one folder for each shard of their key and open them."""
    rows = docs.withColumn("shard", shard_of(key, shards))
    rows.repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").option("compression", runtime.CODEC).parquet(path)
    return open_sharded(docs.sparkSession, path, docs)


def open_sharded(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.withColumn("shard", F.lit(0)).schema).parquet(path).drop("shard")


def update_documents(docs: DataFrame, path: str, shards: int, upserts: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """Replace or add the rows ``upserts`` (columns of ``docs``) and remove the keys ``deletes``, in the shards they lie in.

    A key that is in both is removed. The rows that stay are neither shuffled nor written aside:
    they are read shard by shard and written once, beside the new ones, which come in a file of
    their own. Spark keeps what it writes in a staging folder until the job has ended, so a lost
    task repeats and a failed run leaves the old rows.
    """
    spark = docs.sparkSession
    gone = deletes.select(key).distinct()
    new = upserts.select(*docs.columns).join(_small(gone), key, "left_anti").withColumn("shard", shard_of(key, shards))
    new = runtime.write_scratch(new, "new-rows")
    touched = runtime.write_scratch(new.select(key).union(gone).distinct(), "touched-keys")
    # At most one value a shard; it prunes the folders that are read.
    named = [r[0] for r in touched.select(shard_of(key, shards)).distinct().collect()]
    old = spark.read.schema(docs.withColumn("shard", F.lit(0)).schema).parquet(path).filter(F.col("shard").isin(named))
    kept = old.join(_small(touched), key, "left_anti")
    now = kept.unionByName(new.repartition(max(1, len(named)), "shard"))
    # A shard that lost all its rows has nothing to write; its folder is emptied by a row-less file.
    held = {r[0] for r in now.select("shard").distinct().collect()}
    (
        now.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", runtime.CODEC)
        .partitionBy("shard").parquet(path)
    )
    for shard in sorted(set(named) - held):
        new.limit(0).drop("shard").write.mode("overwrite").parquet(f"{path}/shard={shard}")
    return open_sharded(spark, path, docs)


# -- index ---------------------------------------------------------------------


@dataclass(frozen=True)
class SegmentedIndex:
    """A base index and the segments that are complete below ``path``."""

    base: LexicalIndex
    path: str
    segments: tuple[int, ...] = ()
    id_column: str = "id"
    text_column: str = "full_text"

    def _read(self, what: str, kind: str) -> DataFrame:
        spark = self.base.postings.sparkSession
        parts = [spark.read.schema(kind).parquet(f"{self.path}/segment-{n}/{what}").withColumn("segment", F.lit(n)) for n in self.segments]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{kind}, segment int")

    def _gone(self) -> DataFrame:
        """``doc_id, since``: postings of segments before ``since`` do not count."""
        return self._read("gone", "doc_id long").groupBy("doc_id").agg(F.max("segment").alias("since"))

    def postings(self) -> DataFrame:
        columns = ["term_bucket", "term", "doc_id", "tf", "doc_len", "positions"]
        base = self.base.postings.select(*columns)
        if not self.segments:
            return base
        return reduce(DataFrame.unionByName, self.parts())

    def parts(self) -> tuple[DataFrame, DataFrame]:
        """The postings that count, of the base and of the segments.

        No document is in both: a change of it ends all its earlier postings, and rows without an id, which
        no change can name, are put to the segments. The base keeps its buckets.
        """
        columns = ["term_bucket", "term", "doc_id", "tf", "doc_len", "positions"]
        kind = "term string, doc_id long, tf long, doc_len long, positions array<int>, term_bucket int"
        gone = _small(self._gone())
        live = lambda rows: rows.join(gone, "doc_id", "left").filter(
            F.col("since").isNull() | (F.col("segment") >= F.col("since"))
        ).select(*columns)
        base = self.base.postings.select(*columns).withColumn("segment", F.lit(0))
        later = self._read("postings", kind).select(*columns, "segment").unionByName(base.filter("doc_id is null"))
        return live(base.filter("doc_id is not null")), live(later)

    def merged(self) -> LexicalIndex:
        """An index over the documents as they are now, for every operator that reads one."""
        if not self.segments:
            return self.base
        counts = self._read("corpus", "n_docs long, n_tokens long").drop("segment").unionByName(self.base.corpus_stats.select("n_docs", "n_tokens"))
        totals = counts.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        corpus = totals.withColumn("avg_len", F.col("n_tokens") / F.col("n_docs"))
        changes = self._read("terms", "term string, doc_freq long, term_bucket int").drop("segment")
        summed = self.base.term_stats.select("term_bucket", "term", "doc_freq").unionByName(changes).groupBy("term_bucket", "term").agg(F.sum("doc_freq").alias("doc_freq"))
        stats = summed.filter("doc_freq > 0").withColumn("idf", sc.idf(corpus.select("n_docs").scalar(), F.col("doc_freq")))
        # Not "saved": the terms that a batch asks for are picked before the counts are added up.
        parts = self.parts()
        return LexicalIndex(
            reduce(DataFrame.unionByName, parts), stats, corpus, self.base.analyzer, self.base.term_buckets, saved=False, parts=parts
        )

    def apply(self, known: DataFrame, upserts: DataFrame, deletes: DataFrame) -> "SegmentedIndex":
        """A further segment: ``upserts`` are new or changed documents, ``deletes`` ids; an id in both is removed.

        ``known`` has the ids of all documents before the change.
        """
        number = max(self.segments, default=0) + 1
        home = f"{self.path}/segment-{number}"
        key = F.col(self.id_column).alias("doc_id")
        removed = deletes.select(key).distinct()
        fresh = upserts.join(_small(removed.withColumnRenamed("doc_id", self.id_column)), self.id_column, "left_anti")
        touched = fresh.select(key).union(removed).distinct()
        touched.write.mode("overwrite").parquet(f"{home}/gone")
        spark = known.sparkSession
        touched = spark.read.parquet(f"{home}/gone")
        side = _small(touched)
        lazy = define_index(fresh, self.base.analyzer, self.text_column, self.id_column, self.base.term_buckets)
        lazy.postings.write.mode("overwrite").partitionBy("term_bucket").parquet(f"{home}/postings")
        kind = "term string, doc_id long, tf long, doc_len long, positions array<int>, term_bucket int"
        added = spark.read.schema(kind).parquet(f"{home}/postings")
        lost = self.postings().join(side, "doc_id", "left_semi")
        signed = added.select("term_bucket", "term", "tf", F.lit(1).alias("sign")).unionByName(lost.select("term_bucket", "term", "tf", F.lit(-1).alias("sign")))
        signed = runtime.write_scratch(signed.groupBy("term_bucket", "term").agg(
            F.sum(F.col("sign").cast("long")).alias("doc_freq"), F.sum(F.col("tf") * F.col("sign")).alias("tokens")
        ), "changed-terms")
        signed.filter("doc_freq <> 0").select("term", "doc_freq", "term_bucket").write.mode("overwrite").partitionBy("term_bucket").parquet(f"{home}/terms")
        before = known.select(key).join(side, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
        after = fresh.select(key).agg(F.count(F.lit(1)).alias("n")).scalar()
        corpus = signed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens")).select((after - before).cast("long").alias("n_docs"), F.col("n_tokens").cast("long"))
        corpus.write.mode("overwrite").parquet(f"{home}/corpus")
        return self._complete((*self.segments, number))

    def _complete(self, segments: tuple[int, ...]) -> "SegmentedIndex":
        spark = self.base.postings.sparkSession
        note = spark.createDataFrame([(n,) for n in segments], "segment int").coalesce(1)
        note.write.mode("append").parquet(f"{self.path}/notes/upto={max(segments)}")
        return SegmentedIndex(self.base, self.path, segments, self.id_column, self.text_column)

    def fold(self) -> "SegmentedIndex":
        """All segments as one. Reads and writes the changes, never the base."""
        if len(self.segments) < 2:
            return self
        number = max(self.segments) + 1
        home = f"{self.path}/segment-{number}"
        kind = "term string, doc_id long, tf long, doc_len long, positions array<int>, term_bucket int"
        gone = self._gone()
        gone.select("doc_id").write.mode("overwrite").parquet(f"{home}/gone")
        rows = self._read("postings", kind).join(_small(gone), "doc_id", "left").filter("since is null or segment >= since")
        rows.drop("segment", "since").write.mode("overwrite").partitionBy("term_bucket").parquet(f"{home}/postings")
        terms = self._read("terms", "term string, doc_freq long, term_bucket int").groupBy("term", "term_bucket").agg(F.sum("doc_freq").alias("doc_freq"))
        terms.filter("doc_freq <> 0").select("term", "doc_freq", "term_bucket").write.mode("overwrite").partitionBy("term_bucket").parquet(f"{home}/terms")
        corpus = self._read("corpus", "n_docs long, n_tokens long").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        corpus.write.mode("overwrite").parquet(f"{home}/corpus")
        return self._complete((number,))


def open_segments(base: LexicalIndex, path: str, id_column: str = "id", text_column: str = "full_text") -> SegmentedIndex:
    """The index with the segments of the last note below ``path``; none where nothing was changed yet."""
    spark = base.postings.sparkSession
    try:
        notes = spark.read.parquet(f"{path}/notes")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return SegmentedIndex(base, path, (), id_column, text_column)
    last = notes.agg(F.max("upto")).first()[0]
    segments = sorted({r[0] for r in notes.filter(F.col("upto") == last).select("segment").collect()})
    return SegmentedIndex(base, path, tuple(segments), id_column, text_column)
