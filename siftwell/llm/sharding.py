"""Sharding by balanced label propagation. DataFrame functions only.

Documents are vertices, links between them weighted edges, shards labels. All start
on a hash of their id, which is balanced. In each round a linked document wants the
label with the greatest weight among its neighbours, by one join of the links with
the labels and one aggregation. A table of shards by shards counts who
wants to move where; moves are granted up to the room the target has, with what
leaves it, by a hash of the document, so every round keeps the linked rows of a shard within its quota.
At the end the surplus of shards above their quota, documents without links first,
goes to the shards below, and no two shards differ by more than one row.

Only documents with links take part in the rounds. Nothing but the table of shards
by shards and counts by shard and bucket reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell import runtime

# Rounds, share by which a shard may be above its quota between rounds, buckets for numbering, rows of a large group.
ROUNDS, SLACK, BUCKETS, LARGE = 8, 0.05, 256, 1000


def copy_links(docs: DataFrame) -> DataFrame:
    """(src, dst, weight) between rows of ``node``, ``key``: equal keys are linked by a tree of two levels.

    Members hang below one of about the square root of the group's size of heads, heads
    below the first member, so no vertex has too many links. A member listens to
    its head, a head to the first member, and both a little to those below.
    """
    groups = docs.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("top")).filter("k > 1")
    held = docs.join(groups, "key").withColumn("branch", F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.sqrt("k"))).cast("long"))
    heads = held.groupBy("key", "branch").agg(F.min("node").alias("head"))
    held = held.join(heads, ["key", "branch"])
    up = held.select(F.col("node").alias("a"), F.when(F.col("node") == F.col("head"), F.col("top")).otherwise(F.col("head")).alias("b"), "k").filter("a <> b")
    return up.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(2.0).alias("weight")).union(
        up.select(F.col("b").alias("src"), F.col("a").alias("dst"), (1 / F.col("k")).alias("weight")))


def _chosen(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label, want): the label with the greatest weight, with 1 for the own one, which also wins among equals.

    The own weight keeps two neighbours from swapping their labels for ever.
    """
    votes = links.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("vote")), "dst").select("src", "vote", "weight")
    votes = votes.union(labels.select("node", "label", F.lit(1.0))).groupBy("src", "vote").agg(F.sum("weight").alias("w"))
    mine = labels.select(F.col("node").alias("src"), "label")
    votes = votes.join(mine, "src").withColumn("own", (F.col("vote") == F.col("label")).cast("int"))
    best = votes.groupBy("src").agg(F.first("label").alias("label"), F.max(F.struct(F.round("w", 9), "own", (-F.col("vote")).alias("v"))).alias("best"))
    return best.select(F.col("src").alias("node"), "label", (-F.col("best.v")).cast("int").alias("want"))


def _granted(wanted: DataFrame, sizes: dict[int, int], quota: float, turn: int) -> DataFrame:
    """(node, label): moves are granted by chance up to the room of the target."""
    table = {(r["label"], r["want"]): r["n"] for r in wanted.filter("label <> want").groupBy("label", "want").agg(F.count("*").alias("n")).collect()}
    into, share = {}, {}
    for (_, t), n in table.items():
        into[t] = into.get(t, 0) + n
    for (s, t), n in table.items():
        # Moves that another answers leave sizes as they are; the rest shares the target's room.
        answered = min(n, table.get((t, s), 0))
        alone = sum(m - min(m, table.get((t, x), 0)) for (x, y), m in table.items() if y == t)
        room = max(0.0, quota - sizes.get(t, 0))
        share[(s, t)] = (answered + (n - answered) * min(1.0, room / alone if alone else 1.0)) / n
    if not share:
        return wanted.select("node", "label")
    rate = F.element_at(F.create_map(*[F.lit(x) for (s, t), v in share.items() for x in (f"{s}>{t}", float(v))]), F.concat_ws(">", "label", "want"))
    chance = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
    return wanted.select("node", F.when((F.col("label") != F.col("want")) & (chance < rate), F.col("want")).otherwise(F.col("label")).alias("label"))


def _numbered(df: DataFrame, order: list[Column], group: str) -> DataFrame:
    """``df`` with ``rank``: a gapless number from 0 within ``group``, by ``bucket`` and then ``order``. At most groups * buckets counts are broadcast."""
    counts = df.groupBy(group, "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(group, "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*order)) - 1
    return df.withColumn("within", within).join(F.broadcast(before), [group, "bucket"]).withColumn("rank", F.col("within") + F.col("before")).drop("within", "before")


def balance_shards(vertices: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard, slot) for every row of ``vertices`` (node long, unique).

    links: (src, dst, weight), directed, src listens to dst. Counts of shards
    differ by one at most; slot numbers each shard without gaps from 0. Without links the
    result is the even split by hash. ``order_key``, if vertices has it, keeps equal
    values together where a surplus must be cut.
    """
    label = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(shards)).cast("int")
    n = vertices.count()
    links = runtime.write_scratch(links.select("src", "dst", "weight"), "links")
    linked = links.select(F.col("src").alias("node")).union(links.select(F.col("dst").alias("node"))).distinct()
    labels = runtime.write_scratch(linked.withColumn("label", label("node")), "labels")
    # Rows without links make room at the end, so a shard may fill up with linked rows.
    quota = max(n / shards, labels.count() / shards * (1 + SLACK))
    for turn in range(rounds):
        sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
        wanted = runtime.write_scratch(_chosen(labels, links), "wanted")
        if not wanted.filter("label <> want").limit(1).count():
            break
        moved = _granted(wanted, sizes, quota, turn)
        # Vertices nobody points to keep their label.
        rest = labels.join(wanted, "node", "left_anti")
        labels = runtime.write_scratch(moved.union(rest.select("node", "label")), "labels")

    key = F.col("order_key") if "order_key" in vertices.columns else F.col("node")
    placed = vertices.select("node", key.alias("order_key")).join(labels, "node", "left")
    placed = placed.select("node", "order_key", F.coalesce("label", label("node")).alias("label"), F.col("label").isNull().alias("lone"))
    # Linked rows have the lower buckets, so that a surplus is taken from rows without links first.
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("order_key", F.lit(2)), F.lit(BUCKETS)).cast("int") + F.when(F.col("lone"), BUCKETS).otherwise(0))
    placed = runtime.write_scratch(_numbered(placed, [F.col("order_key"), F.col("node")], "label"), "placed")
    sizes = {r["label"]: r["n"] for r in placed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sizes = {s: sizes.get(s, 0) for s in range(shards)}
    quota = {s: n // shards + (i < n % shards) for i, s in enumerate(sorted(range(shards), key=lambda s: (-sizes[s], s)))}
    # Surplus rows are numbered through all shards and dealt to the shards with room, in order.
    surplus, room, at = F.lit(None).cast("long"), [], 0
    for s in range(shards):
        if sizes[s] > quota[s]:
            surplus = F.when((F.col("label") == s) & (F.col("rank") >= quota[s]), F.col("rank") - quota[s] + at).otherwise(surplus)
            at += sizes[s] - quota[s]
    begin = 0
    for s in range(shards):
        if sizes[s] < quota[s]:
            room.append((s, begin, sizes[s]))
            begin += quota[s] - sizes[s]
    shard, slot = F.col("label"), F.col("rank")
    for s, first, held in room:  # the last range that begins at or before the number holds it
        shard = F.when(F.col("surplus") >= first, F.lit(s)).otherwise(shard)
        slot = F.when(F.col("surplus") >= first, F.col("surplus") - first + held).otherwise(slot)
    return placed.withColumn("surplus", surplus).select("node", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of all rows of ``doc_id``, ``text``; equal texts are linked.

    The law is ``rows``. size is the number of UTF-8 bytes plus 1; a null text has size 1, the
    crc32 of an empty text and no link. Empty texts are equal texts. Repeated rows are rows of their own.
    """
    text = F.col("text").cast("binary")
    facts = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))).alias("key"),
    )
    facts = runtime.write_scratch(facts.withColumn("node", F.monotonically_increasing_id()), "facts")
    links = copy_links(facts.filter("key is not null").select("node", "key"))
    # Small groups stay together where a surplus is cut; a large one is numbered by row, in many tasks.
    large = runtime.write_scratch(facts.filter("key is not null").groupBy("key").count().filter(F.col("count") > LARGE).select("key"), "large")
    marked = facts.join(large.withColumn("is_large", F.lit(True)), "key", "left")
    vertices = marked.select("node", F.when(F.col("key").isNull() | F.col("is_large"), F.col("node")).otherwise(F.col("key.a")).alias("order_key"))
    placed = balance_shards(vertices, links, shards, rounds)
    return facts.join(placed, "node").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
