"""Document sources and sinks: markdown folders, front matter, keys, tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell import runtime, schema
from siftwell.functions import text as tx

MARKER = "---"
DEFAULT_CATEGORY = "general"
# Fixed value: bits that hold the row number in Spark's increasing id.
ROW_BITS = 33


def scan_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``source_file, value``: whole ``*.md`` files, without readme files."""
    files = (
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
        .select(F.col("_metadata.file_name").alias("source_file"), "value")
    )
    return files.filter(~F.lower("source_file").startswith("readme"))


# -- many small files ----------------------------------------------------------


#: Bytes of files that one task reads; a file counts as at least OPEN_BYTES.
SPLIT_BYTES, OPEN_BYTES = 64 << 20, 16 << 10
# Schemes of stores under the names that Arrow knows them by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gs": "gs"}


def _store(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path on it, what to put before its paths)."""
    scheme, found, rest = path.partition("://")
    if not found:
        plain = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + plain.lstrip("/"), ""
    system, inner = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{scheme}://"


def list_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``path, source_file, size`` of the ``*.md`` files below ``folder``, without readme files.

    Folders are listed by tasks, one level at a time; what the driver sees is the number of levels.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, inner, before = _store(folder)
                found = system.get_file_info(fs.FileSelector(inner))
                yield pa.RecordBatch.from_arrays([
                    pa.array([before + f.path for f in found], pa.string()), pa.array([f.base_name for f in found], pa.string()),
                    pa.array([f.size or 0 for f in found], pa.int64()), pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()),
                ], ["path", "source_file", "size", "folder"])

    level = spark.createDataFrame([(folder.rstrip("/"),)], "path string")
    levels = []
    while True:
        rows = level.select("path").repartition(spark.sparkContext.defaultParallelism) if levels else level
        found = runtime.write_scratch(rows.mapInArrow(scan, "path string, source_file string, size long, folder boolean"), "listed-files")
        levels.append(found.filter("not folder").select("path", "source_file", "size"))
        level = found.filter("folder and not source_file like '.%' and not source_file like '\\_%'")
        if level.isEmpty():
            break
    name = F.lower("source_file")
    return reduce(DataFrame.unionByName, levels).filter(F.col("source_file").endswith(".md") & ~name.startswith("readme"))


def read_packed(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``source_file, value`` of listed files, packed into tasks of about ``split_bytes`` by their measured sizes.

    Files are dealt by a hash into as many splits as their sizes ask for; one larger than a
    split is read whole, like any file, because its header is at its start. Bytes that are
    no UTF-8 become replacement characters. A file that went missing since it was listed has a NULL value.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner, _ = _store(path)
                try:
                    with system.open_input_stream(inner) as f:
                        value = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    value = None
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([value], pa.string())], ["source_file", "value"])

    total = files.agg(F.sum(F.greatest("size", F.lit(OPEN_BYTES)))).first()[0] or 0
    splits = max(1, -(-total // split_bytes))
    dealt = files.select("path", "source_file").repartition(splits, F.xxhash64("path"))
    return dealt.mapInArrow(read, "source_file string, value string")


def write_markdown(files: DataFrame, folder: str, per_folder: int = 10_000) -> None:
    """Write ``source_file, value`` as files of these names, dealt over sub-folders by a hash of the name.

    Tasks write; a repeated task replaces its own files by equal ones.
    """
    folder = folder.rstrip("/")
    n = max(1, -(-files.count() // per_folder))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, made = 0, set()
        for batch in batches:
            for name, value, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, inner, _ = _store(f"{folder}/part-{part:05d}")
                if part not in made:
                    system.create_dir(inner, recursive=True)
                    made.add(part)
                with system.open_output_stream(f"{inner}/{name}") as f:
                    f.write((value or "").encode())
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])

    rows = files.select("source_file", "value", F.pmod(F.xxhash64("source_file"), F.lit(n)).cast("int").alias("part"))
    rows.mapInArrow(write, "written long").agg(F.sum("written")).collect()


def _strip(c: Column) -> Column:
    """Remove white space of any kind, line ends included, at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def parse_front_matter(files: DataFrame, value: str = "value") -> DataFrame:
    """Add ``title, content, category, metadata, error`` to whole-file text.

    The header runs from the leading marker to the first marker after it. A
    line of the header is a key and a value around its first colon; the last
    one of equal keys counts. Exactly one of ``title`` and ``error`` is set.
    """
    end = F.locate(MARKER, F.col(value), len(MARKER) + 1)
    header = _strip(F.substring(F.col(value), F.lit(len(MARKER) + 1), F.col("_end") - len(MARKER) - 1))

    def pair(line: Column) -> Column:
        colon = F.locate(":", line)
        return F.struct(
            colon.alias("colon"),
            _strip(F.substring(line, F.lit(1), colon - 1)).alias("key"),
            _strip(F.substring(line, colon + 1, F.length(line))).alias("value"),
        )

    pairs = F.filter(F.transform(F.split("_header", "\n"), pair), lambda p: p["colon"] > 1)

    def last(key: Column | str) -> Column:
        same = F.filter("_pairs", lambda p: p["key"] == key)
        return F.try_element_at(same, F.lit(-1))["value"]

    staged = (
        files.withColumn("_end", end).withColumn("_header", header).withColumn("_pairs", pairs)
    )
    keys = F.array_distinct(F.transform("_pairs", lambda p: p["key"]))
    title = F.nullif(last("title"), F.lit(""))
    category = F.coalesce(F.nullif(last("category"), F.lit("")), F.lit(DEFAULT_CATEGORY))
    error = (
        F.when(~F.col(value).startswith(MARKER), "missing front matter")
        .when(F.col("_end") == 0, "missing closing marker")
        .when(title.isNull(), "missing title")
    )
    body = _strip(F.substring(F.col(value), F.col("_end") + len(MARKER), F.length(value)))
    parsed = staged.withColumn("error", error)
    good = F.col("error").isNull()
    return parsed.select(
        *files.columns,
        F.when(good, title).alias("title"),
        F.when(good, body).alias("content"),
        F.when(good, category).alias("category"),
        F.when(good, F.map_from_arrays(keys, F.transform(keys, last))).alias("metadata"),
        "error",
    )


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good documents, rejected files with their error)."""
    good = parsed.filter(F.col("error").isNull()).drop("error")
    bad = parsed.filter(F.col("error").isNotNull()).select("source_file", "error")
    return good, bad


def assign_keys(df: DataFrame, order_by: list[str], key: str = "id", start: int = 1) -> DataFrame:
    """Consecutive numbers in the order of ``order_by``, which must be unique.

    Only the order columns are sorted, over a range partitioning. The numbered
    keys are written once, so that the row counts per partition and the row
    numbers come from the same run; the counts (one row per partition) become
    offsets and the numbers are joined back.
    """
    ordered = df.select(*order_by).repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    numbered = runtime.write_scratch(
        ordered.withColumn("_n", F.monotonically_increasing_id()), "row-numbers"
    )
    part = F.shiftright("_n", ROW_BITS)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    in_part = F.col("_n") - F.shiftleft("_part", ROW_BITS)
    keys = numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(
        *order_by, (F.col("_offset") + in_part + start).alias(key)
    )
    return df.join(keys, order_by)


def hashed_key(path: Column) -> Column:
    """A stable key that needs no order; two of 2**32 paths may well share one."""
    return F.xxhash64(path)


def derive_columns(docs: DataFrame) -> DataFrame:
    """Add ``full_text`` and ``word_count`` to ``title, content``."""
    text = tx.full_text("title", "content")
    return docs.withColumn("full_text", text).withColumn("word_count", tx.word_count(text))


def inline_documents(spark: SparkSession, rows: list[tuple[int, str, str, str | None]]) -> DataFrame:
    """A small corpus from ``(id, title, content, category)`` rows."""
    base = spark.createDataFrame(rows, "id long, title string, content string, category string")
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit(DEFAULT_CATEGORY))
    return derive_columns(base.withColumn("category", category)).withColumn(
        "embedding", F.lit(None).cast("array<float>")
    ).select(*schema.DOCUMENTS.fieldNames())


def write_documents(docs: DataFrame, path: str, name: str, shards: int) -> DataFrame:
    """Replace the documents table, bucketed by id, and open it.

    Postings are bucketed by the same key into the same number of shards, so
    building an index and joining it to documents need no shuffle of the text.
    ``name`` is the catalog name; the table itself lies at ``path``.
    """
    spark = docs.sparkSession
    runtime.forget_table(spark, name)
    (
        docs.repartition(shards, "id").write.mode("overwrite").format("parquet")
        .bucketBy(shards, "id").sortBy("id").option("path", path).option("compression", runtime.CODEC).saveAsTable(name)
    )
    return spark.table(name)


def write_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result rows as files, one folder per ``method``."""
    results.write.mode("overwrite").partitionBy("method").format(fmt).save(path)


def ordered_texts(docs: DataFrame) -> DataFrame:
    """``id, title, full_text`` in order of id."""
    return docs.select("id", "title", "full_text").orderBy("id")


def count_words_of(docs: DataFrame, phrase: str) -> DataFrame:
    """``id, category, n``: literal occurrences of ``phrase`` in the content."""
    n = tx.literal_count(F.lower("content"), F.lit(phrase.lower()))
    return docs.select("id", "category", n.cast("long").alias("n"))
