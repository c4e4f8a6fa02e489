"""Session-level helpers: the shared folder, reliable scratch tables, broadcast limits.

Nothing here is specific to retrieval.  The two rules the rest of the package
relies on are (1) lineage is cut only by writing a table to the shared folder
named in ``spark.checkpoint.dir`` and (2) a side is broadcast only when its
size has been measured and lies under a limit.
"""

from __future__ import annotations

import contextlib
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper limit for one broadcast side, in bytes of the measured payload.
BROADCAST_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as configured by the cluster.

    A temporary folder is used only where the setting is absent and all tasks run on this
    machine, as in tests; on a cluster its files would be missing elsewhere.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="siftwell-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, private to this application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/siftwell/{app}/{name}-{uuid.uuid4().hex[:12]}"


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later plans start from files.

    Unlike a cache, the result survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Fixed value: how tables of text and of postings are packed.
CODEC = "zstd"

# Fixed value: upper limit of shards of a written table, to keep the exchange
# that fills them and the number of files manageable.
MAX_SHARDS = 32768
# Text and rows of one shard. A task sorts the postings of a shard and holds a
# score for each of its documents and queries, so these bound its memory whatever the input.
SHARD_BYTES, SHARD_ROWS = 16 << 20, 10_000


def default_shards(df: DataFrame, text_column: str) -> int:
    """One shard per SHARD_BYTES of text or SHARD_ROWS rows, at least one per core and at most MAX_SHARDS.

    Both are measured: input splits differ with the compression and the settings of a session.
    """
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_column)), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, min(max(-(-size // SHARD_BYTES), -(-rows // SHARD_ROWS)), MAX_SHARDS))


@contextlib.contextmanager
def bucket_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Plans run inside read a bucketed table with one task for each bucket.

    Spark drops a repartitioning that the buckets already satisfy, and then, as nothing else
    asks for the buckets, packs files of several into splits as large as the input allows.
    """
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def limit_tasks(df: DataFrame, most: int = MAX_SHARDS) -> DataFrame:
    """Merge input splits, without a shuffle, until at most ``most`` tasks are left.

    For stages that stream their input but return something per task.
    """
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df


def forget_table(spark: SparkSession, name: str) -> None:
    """Drop the name of an external table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the tasks, once per application.

    Not needed where the cluster has it installed or gets it by ``--py-files``.
    """
    context = spark.sparkContext
    if getattr(context, "_siftwell_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="siftwell-code-")) / "siftwell.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._siftwell_shipped = True
