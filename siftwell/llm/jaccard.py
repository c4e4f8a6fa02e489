"""N-gram Jaccard join by multiple global orders of the shingles.

Two sets with a Jaccard similarity of at least t share a token in the first
``n - ceil(t * n) + 1`` tokens of each, under EVERY total order of all tokens.
Three orders are used; all begin with the tokens that one text alone has, which
cannot be shared.  The first goes on by document frequency, the others by two
hashes.  Only pairs whose prefixes meet in all three orders are verified; where
the partner's size is known the prefixes are shortened to what the pair needs.

Stages, each a Spark job over all documents:

1. one row per document: a 64-bit key of its word sequence and its set size;
   documents with equal sequences are one class from here on;
2. shingle hashes, packed into blocks by hash range, are grouped by range; what
   only one class has is dropped, the rest goes back to its class with its
   document frequency.  A class whose shared part is too small is done;
3. rounds that pair each class with one centre per shared first-order token join
   large groups of near copies by a number of pairs that is linear in the group;
4. the exact round: all classes that meet in the first order, in pairs of
   different components, filtered by the other orders, then verified;
5. components of all verified links.

Any share of all rows may have one text (one class) or near copies of it (joined
in step 3) or a common passage (last in the first order).  No group is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.llm import arrays as ar
from siftwell.llm.components import connected_components

# Seeds of the second and third order.
ORDER_SEEDS = (0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D)
# Fixed value: rounds with centres before the exact round.
CENTRE_ROUNDS = 2
FLUSH_TOKENS = 1 << 20


def _least_shared(n, percent: int):
    """ceil(percent/100 * n), in whole numbers."""
    return (n * percent + 99) // 100


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, cls, n_shingles): the key of the word sequence (null without words) and the set size."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            keys, sizes = [], []
            for _, _, offsets, data in ar.text_slices(texts):
                h, _, _, at = ar.words(ar.LOWER[data], offsets)
                for i in range(len(offsets) - 1):
                    own = h[at[i] : at[i + 1]]
                    keys.append(ar.content_key(own) if len(own) else None)
                    sizes.append(len(ar.shingles(own, width)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "cls", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(ar.tidy(run), "doc_id long, cls long, n_shingles long")


def _pack(names: np.ndarray, sizes: np.ndarray, owner: np.ndarray, *columns: np.ndarray) -> bytes:
    """A block: the classes that own something in it with their set sizes, how much each owns, and its columns, by class."""
    who, counts = np.unique(owner, return_counts=True)
    head = [np.array([len(who), len(owner)], np.int64), names[who], sizes[who].astype(np.uint32), counts.astype(np.uint32)]
    return b"".join(x.tobytes() for x in (*head, *columns))


def _unpack(block: bytes, *kinds: type) -> list[np.ndarray]:
    """Class and set size of each element, then the columns."""
    n, m = np.frombuffer(block, np.int64, 2)
    names = np.frombuffer(block, np.int64, n, 16)
    sizes, counts = np.frombuffer(block, np.uint32, 2 * n, 16 + 8 * n).reshape(2, n)
    out, at = [np.repeat(names, counts), np.repeat(sizes, counts)], 16 + 16 * n
    for kind in kinds:
        out.append(np.frombuffer(block, kind, m, at))
        at += m * np.dtype(kind).itemsize
    return out


def _dealt(key: np.ndarray, parts: int):
    """(part, elements of the part in their order) of the parts that have any."""
    order = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p] : cuts[p + 1]]


def _token_blocks(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """(part, block): shingles by hash range, with 48 bits each; a task packs about FLUSH_TOKENS at a time."""

    def flush(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        names, sizes = np.fromiter(sets, np.int64, len(sets)), np.array([len(x) for x in sets.values()])
        tokens, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), sizes)
        found, blocks = [], []
        for p, own in _dealt(((tokens >> np.uint64(48)) % np.uint64(parts)).astype(np.int64), parts):
            low = tokens[own]
            found.append(p)
            blocks.append(_pack(names, sizes, owner[own], low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16)))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    def run(batches):
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for _, _, offsets, data in ar.text_slices(batch.column(0)):
                h, _, _, at = ar.words(ar.LOWER[data], offsets)
                for i in range(len(offsets) - 1):
                    own = h[at[i] : at[i + 1]]
                    if len(own) and (key := ar.content_key(own)) not in sets:
                        sets[key] = ar.shingles(own, width)
                        held += len(sets[key])
                if held >= FLUSH_TOKENS:
                    yield flush(sets)
                    sets, held = {}, 0
        if sets:
            yield flush(sets)

    return docs.select("text").mapInArrow(ar.tidy(run), "part int, block binary")


def _joined_blocks(table: pa.Table, *kinds: type) -> list[np.ndarray]:
    parts = [_unpack(x.as_py(), *kinds) for x in table.column("block").combine_chunks()]
    return [np.concatenate(x) for x in zip(*parts)]


def _shared_tokens(parts: int):
    """Of one hash range: the tokens that more than one class has, with their document frequency, dealt by class."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        owner, size, low, high = _joined_blocks(table, np.uint32, np.uint16)
        tokens = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        order = np.argsort(tokens, kind="stable")
        same = np.zeros(len(tokens), bool)
        same[1:] = tokens[order][1:] == tokens[order][:-1]
        lone = ~same
        lone[:-1] &= ~same[1:]
        order = order[~lone]
        order = order[np.lexsort((owner[order], tokens[order]))]
        tokens, owner, size = tokens[order], owner[order], size[order]
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner, size = tokens[keep], owner[keep], size[keep]
        _, which, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        df = counts[which]
        held = np.flatnonzero(df > 1)
        held = held[np.argsort(owner[held], kind="stable")]
        names, first, place = np.unique(owner[held], return_index=True, return_inverse=True)
        ids = tokens[held] | (np.uint64(key[0].as_py()) << np.uint64(48))
        found, blocks = [], []
        for p, own in _dealt(names[place] % parts, parts):
            found.append(p)
            blocks.append(_pack(names, size[held][first], place[own], ids[own], df[held][own].astype(np.uint32)))
        return pa.table({"part": pa.array(found, pa.int32()), "block": pa.array(blocks, pa.binary())})

    return run


def _classes(percent: int):
    """Of the classes of one part, those with enough shared tokens: sorted tokens and the prefixes in three orders."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        owner, size, tokens, df = _joined_blocks(table, np.int64, np.uint32)
        order = np.argsort(owner, kind="stable")
        names, first = np.unique(owner[order], return_index=True)
        out: dict[str, list] = {k: [] for k in ("cls", "n", "typical", "tokens", "p1", "p2", "p3")}
        for name, own in zip(names, np.split(order, first[1:])):
            n, t, d = int(size[own[0]]), tokens[own], df[own]
            if len(t) < _least_shared(n, percent):
                continue
            prefix = (n - _least_shared(n, percent) + 1) - (n - len(t))
            out["cls"].append(name)
            out["n"].append(n)
            out["typical"].append(float(d.sum() / n))
            out["tokens"].append(np.sort(t))
            out["p1"].append(t[np.lexsort((t, d))[:prefix]])
            for k, seed in zip(("p2", "p3"), ORDER_SEEDS):
                out[k].append(t[np.argsort(ar.mix(t.view(np.uint64) ^ np.uint64(seed)))[:prefix]])
        kinds = {"cls": pa.int64(), "n": pa.int64(), "typical": pa.float64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.list_(pa.int64()))) for k, v in out.items()})

    return run


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose prefixes meet in the second and third order and whose sets are similar enough."""
    small = classes.select("cls", "n", F.size("tokens").alias("held"), "p2", "p3")
    near = pairs
    for side in "ab":
        near = near.join(small.select(*[F.col(c).alias(side if c == "cls" else side + c) for c in small.columns]), side)
    need = f"(({percent} * (an + bn) + {99 + percent}) div {100 + percent})"  # the least intersection
    meet = " and ".join(
        f"arrays_overlap(slice(a{p}, 1, cast(greatest(0, aheld - {need} + 1) as int)), slice(b{p}, 1, cast(greatest(0, bheld - {need} + 1) as int)))"
        for p in ("p2", "p3"))
    near = near.filter(F.expr(meet)).select("a", "b", F.col("an").alias("na"), F.col("bn").alias("nb"))
    sets = classes.select("cls", "tokens")
    both = near.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a")
    both = both.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("ta", "tb")))
    both = both.filter(F.expr(f"100 * common >= {percent} * (na + nb - common)"))
    return both.select("a", "b", "common", (F.col("na") + F.col("nb") - F.col("common")).alias("joined"))


def _placed(postings: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Postings with the component each class is in so far."""
    if joined is None:
        return postings.withColumn("comp", F.col("cls"))
    named = joined.select(F.col("node").alias("cls"), "root")
    return postings.join(named, "cls", "left").select("cls", "n", "typical", "t", "pos", F.coalesce("root", "cls").alias("comp"))


def _with_centre(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each class with two classes of other components per shared token.

    One is the most typical, with the highest mean document frequency of its
    tokens, since near copies of a text resemble it more than each other. The
    other, and from the second round on both, are the first by a hash of the round.
    """
    fields = F.struct("cls", "n", "comp")
    rank = F.xxhash64("cls", F.lit(turn))
    typical = F.struct("typical", "cls") if turn == 0 else F.xxhash64("cls", F.lit(-turn))
    centre = placed.groupBy("t").agg(F.array(F.min_by(fields, rank), F.max_by(fields, typical)).alias("cs"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # Written, so that the join can split a token that a large share of all classes has.
    centre = runtime.write_scratch(centre.filter("lo <> hi").select("t", F.explode("cs").alias("c")), "centres")
    pairs = placed.join(centre, "t")
    pairs = pairs.filter(F.expr(f"comp <> c.comp and 100 * least(n, c.n) >= {percent} * greatest(n, c.n)"))
    return pairs.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct()


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, components) of texts whose shingle sets are similar.

    docs: ``doc_id`` and ``text``; other columns are ignored, whatever their names.
    documents: doc_id, cls, n_shingles, one row per input row; cls is null
    for a null text or one without words, which links with nothing. links: pairs
    (a, b) of classes with the sizes of the intersection and the union; they span
    the components and include every link between classes that the rounds with
    centres had not joined. components: (node, root) of classes with links.

    Two texts with the same words in the same order are one class. Shingles are
    compared by 48 to 64 bits of a hash; word sequences by 64 bits.
    """
    spark = docs.sparkSession
    runtime.ship_package(spark)
    documents = runtime.write_scratch(profiles(docs, width), "profiles")
    splits = docs.rdd.getNumPartitions()
    parts = min(65536, max(int(spark.conf.get("spark.sql.shuffle.partitions")), splits))
    blocks = _token_blocks(docs, width, parts).groupBy("part").applyInArrow(ar.tidy_group(_shared_tokens(parts)), "part int, block binary")
    kinds = "cls long, n long, typical double, tokens array<long>, p1 array<long>, p2 array<long>, p3 array<long>"
    classes = runtime.write_scratch(blocks.groupBy("part").applyInArrow(ar.tidy_group(_classes(percent)), kinds), "classes")

    postings = runtime.write_scratch(classes.select(
        "cls", "n", "typical", F.posexplode("p1").alias("i", "t"), (F.col("n") - F.size("tokens")).alias("lone")
    ).select("cls", "n", "typical", "t", (F.col("lone") + F.col("i")).alias("pos")), "postings")
    links = joined = None
    for turn in range(CENTRE_ROUNDS):
        placed = _placed(postings, joined)
        pairs = _with_centre(placed, turn, percent)
        found = runtime.write_scratch(_verified(pairs, classes, percent), "links")
        links = found if links is None else links.union(found)
        spanning = found.select("a", "b")
        if joined is not None:
            spanning = spanning.union(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))
        joined = connected_components(spanning)
    placed = runtime.write_scratch(_placed(postings, joined), "postings")
    # Of each token, the members of its largest component meet the others but not each other.
    sizes = placed.groupBy("t", "comp").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("t").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.count("*").alias("parts"))
    mixed = runtime.write_scratch(mixed.filter("parts > 1").select("t", "major"), "mixed")
    minor = runtime.write_scratch(placed.join(mixed, "t").filter("comp <> major").select("t", "cls", "n", "pos", "comp"), "minor")
    other = placed.select("t", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"))
    # The first common token of two similar sets has enough tokens behind it in both.
    pairs = minor.join(other, "t").filter(F.expr(
        f"comp <> comp2 and {100 + percent} * least(n - pos, n2 - pos2) >= {percent} * (n + n2)"))
    pairs = pairs.select(F.least("cls", "cls2").alias("cls"), F.greatest("cls", "cls2").alias("cls2"))
    pairs = runtime.write_scratch(pairs.select(F.col("cls").alias("a"), F.col("cls2").alias("b")).distinct(), "pairs")
    found = runtime.write_scratch(_verified(pairs, classes, percent), "links")
    # The components so far already span their own links.
    spanning = joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found.select("a", "b"))
    return documents, links.union(found), connected_components(spanning)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable by links, itself included.

    Rows without words are alone. A null doc_id is ignored as a representative.
    """
    documents, _, components = jaccard_links(docs, width, percent)
    roots = documents.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    roots = roots.join(components, roots.cls == components.node, "left").select("cls", "first_id", F.coalesce("root", "cls").alias("comp"))
    least = roots.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = roots.join(least, "comp").select("cls", "component_id")
    return documents.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
