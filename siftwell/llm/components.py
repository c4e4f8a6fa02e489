"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import runtime

MAX_ROUNDS = 60


def _facts(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node long, root long) of all nodes that are not the smallest of their component.

    Alternates the large-star and the small-star step: every step hangs nodes
    below the smallest neighbour, and a logarithmic number of rounds is enough in
    practice.  The links of one node may be any share of all; minima are combined
    before the shuffle and the join back can be split.  Every round is written to
    the shared folder, so a lost executor costs one step.  Self-links and nulls
    are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    e = e.filter("u <> v and u is not null and v is not null").distinct()
    e = runtime.write_scratch(e, "links")
    facts = _facts(e)
    for _ in range(MAX_ROUNDS):
        if not facts[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = runtime.write_scratch(small, "links")
        now = _facts(e)
        if now == facts:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        facts = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
