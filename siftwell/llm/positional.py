"""Benchmark passages in documents, by a positional inverted index. DataFrame functions only.

The index is a stored table of postings (document, term, position) of every term
that occurs in a test item; other terms cannot be in a match and need no
postings. A test window names its terms with their offsets, rarest first by the
number of postings in the index. Documents whose postings of the two rarest terms
meet once they are adjusted by their offsets are candidates; for each of them the
position lists of all the window's terms are intersected in this way from the rarest
on, and what is left are the exact places of the phrase. ``near_matches`` asks for the same terms in any order within a span.

Position lists belong to one document, so no list grows with the corpus. A term
or a passage may be in any share of the documents: every step is linear in the
postings and in the matching (document, window) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell import runtime

#: Test terms and test windows that are broadcast at most, at about 40 and 400 bytes each; above, they are shuffled.
BROADCAST_TERMS, BROADCAST_WINDOWS = 500_000, 50_000
WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: runs of digits, ASCII letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Words of a text, not yet lower-cased; null has none."""
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def lowered(word: str) -> Column:
    """A-Z lower-cased; other letters as they are."""
    plain = F.length(word) == F.octet_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(wid, terms, items): the distinct windows of ``item_id``, ``text``, as word lists, with the items that have each."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), F.posexplode(words("text")).alias("pos", "w"), F.xxhash64("item_id", "text").alias("row"))
    w = w.select("item_id", "row", "pos", lowered("w").alias("w")).groupBy("item_id", "row").agg(F.array_sort(F.collect_set(F.struct("pos", "w"))).alias("ws"))
    w = w.select("item_id", F.transform("ws", lambda x: x["w"]).alias("ws"))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1)), lambda i: F.slice("ws", i, window))
    w = w.select("item_id", F.explode(each).alias("terms"))
    w = w.groupBy("terms").agg(F.collect_set("item_id").alias("items"))
    return w.select(F.xxhash64("terms").alias("wid"), "terms", "items")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Store (row, doc_id, pos, h) for every word of ``docs`` that is in ``vocabulary`` (w, h).

    One more posting per row, with h null, has the doc_id and, as its position, the number of
    words. row tells rows with one doc_id apart.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words("text").alias("ws"))
    each = rows.select("row", "doc_id", F.posexplode(F.concat("ws", F.array(F.lit("")))).alias("pos", "w"))
    each = each.select("row", "doc_id", "pos", lowered("w").alias("w"))
    ends = vocabulary.select("w", "h").union(vocabulary.sparkSession.sql("select '' as w, cast(null as long) as h"))
    postings = each.join(_small(runtime.write_scratch(ends, "vocabulary"), BROADCAST_TERMS), "w")
    return runtime.write_scratch(postings.select("row", F.when(F.col("h").isNull(), F.col("doc_id")).alias("doc_id"), "pos", "h"), "postings")


def _ranked_windows(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(wid, lists, n, items): terms with offsets, rarest first; windows with a term that no document has are gone."""
    counts = index.filter("h is not null").groupBy("h").agg(F.count("*").alias("df"))
    terms = windows.select("wid", "items", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "w")).withColumn("h", F.xxhash64("w"))
    terms = terms.join(counts, "h")
    ranked = terms.groupBy("wid", "items", "n").agg(F.array_sort(F.collect_list(F.struct("df", "off", "h"))).alias("lists"))
    return runtime.write_scratch(ranked.filter("size(lists) = n"), "windows")


def _lists_of(index: DataFrame, found: DataFrame) -> DataFrame:
    """(row, lists_of): position lists by term of the documents in ``found``."""
    rows = found.select("row").distinct()
    held = index.filter("h is not null").join(_small(rows, BROADCAST_TERMS), "row", "left_semi")
    lists = held.repartition("row").groupBy("row", "h").agg(F.collect_list("pos").alias("at"))
    return lists.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("h", "at"))).alias("lists_of"))


def _phrase_candidates(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(row, wid) where the two rarest terms of a window stand at the distance they have in it."""
    anchors = ranked.select("wid", F.explode(F.slice("lists", 1, 2)).alias("t"), F.least("n", F.lit(2)).alias("need"))
    anchors = anchors.select("wid", "need", F.col("t.h").alias("h"), F.col("t.off").alias("off"))
    starts = index.filter("h is not null").join(_small(anchors, BROADCAST_WINDOWS), "h").select("row", "wid", "need", (F.col("pos") - F.col("off")).alias("start"))
    # Postings of a document lie in one task, so nearly all single hits are counted before the shuffle.
    met = starts.groupBy("row", "wid", "start", "need").agg(F.count("*").alias("k")).filter("k = need")
    return runtime.write_scratch(met.select("row", "wid").distinct(), "candidates")


def _near_candidates(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(row, wid) where a document has the rarest term of a window."""
    anchors = ranked.select("wid", F.col("lists")[0]["h"].alias("h"))
    found = index.filter("h is not null").join(_small(anchors, BROADCAST_WINDOWS), "h").select("row", "wid").distinct()
    return runtime.write_scratch(found, "candidates")


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, wid, n, items, starts): the places where a window's words follow one another in a document."""
    ranked = _ranked_windows(windows, index)
    found = _phrase_candidates(index, ranked)
    pairs = found.join(_lists_of(index, found), "row").join(_small(ranked, BROADCAST_WINDOWS), "wid")

    def meet(starts, term):
        at = F.transform(F.coalesce(F.col("lists_of")[term["h"]], F.array().cast("array<int>")), lambda p: p - term["off"])
        return F.when(F.size(starts) == 0, starts).otherwise(F.array_intersect(starts, at))

    first = F.transform(F.col("lists_of")[F.col("lists")[0]["h"]], lambda p: p - F.col("lists")[0]["off"])
    starts = F.aggregate(F.slice("lists", 2, 2**30), first, meet)
    return pairs.select("row", "wid", "n", "items", starts.alias("starts")).filter("size(starts) > 0")


def near_matches(index: DataFrame, windows: DataFrame, span: int) -> DataFrame:
    """(row, wid, n, items, places): where all distinct terms of a window lie within ``span`` words from the rarest, in any order."""
    ranked = _ranked_windows(windows, index)
    found = _near_candidates(index, ranked)
    pairs = found.join(_lists_of(index, found), "row").join(_small(ranked, BROADCAST_WINDOWS), "wid")

    def close(p):
        return F.forall(F.col("lists"), lambda t: F.exists(F.coalesce(F.col("lists_of")[t["h"]], F.array().cast("array<int>")), lambda q: F.abs(q - p) < span))

    places = F.filter(F.col("lists_of")[F.col("lists")[0]["h"]], close)
    return pairs.select("row", "wid", "n", "items", places.alias("places")).filter("size(places) > 0")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside an occurrence of any window is hit. An item of fewer words than a
    window is one window; one without words, or null, has none. A null text has no
    words. Items without an id count as hits but not as items.
    """
    windows = runtime.write_scratch(test_windows(items, window), "test-windows")
    vocabulary = windows.select(F.explode("terms").alias("w")).distinct().select("w", F.xxhash64("w").alias("h"))
    index = build_index(docs, vocabulary)
    matches = phrase_matches(index, windows)
    spans = F.transform("starts", lambda s: F.struct(s.alias("a"), (s + F.col("n")).alias("b")))
    hits = matches.groupBy("row").agg(
        F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
        lambda s: s["n"],
    )
    hits = hits.select("row", covered.alias("n_hit"), "items")
    out = index.filter("h is null").select("row", "doc_id", F.col("pos").cast("long").alias("n_words")).join(hits, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
