"""Line dedup by alignment: common blocks of overlapping documents go from the later one.

A line is what line breaks and sentence ends delimit, compared by its words
without regard to case or spacing. A run is the shortest sequence of consecutive lines
of enough words from one line on, forwards or backwards: every line of a common block is
in a run inside the block. Each run points from every document that has it to the first
one (by doc_id) that has it, so every common block has a partner for each of its runs, at
one pair for each run and document at most, however many documents share the run. A pair
is aligned by patience diff: lines that are unique in both texts are anchors, the longest
increasing run of anchors is kept, matches grow from them, and the gaps are
searched again. Aligned blocks of enough words are deleted from the later document. An
alignment keeps one order and one partner of each line, so what is left of the later
document is aligned again around the runs that the earlier one has too, until none of them is
left: blocks in another order, and blocks that either text repeats. So a line goes if,
and only if, it is in an aligned common block of enough words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siftwell import runtime
from siftwell.llm import arrays as ar

#: Words of a block that is deleted, at least.
BLOCK_WORDS = 20
#: Lines on either side of a run that are aligned with it.
AROUND = 32
#: Rows of a batch while texts are read and rewritten, at most.
BATCH_ROWS = 2000
#: Bytes that end a sentence where a blank follows.
STOP = np.zeros(256, bool)
STOP[[33, 46, 63]] = True
BREAK = np.zeros(256, bool)
BREAK[[10, 11, 12, 13]] = True


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word count, first byte, end byte, bounds by row) of the lines that have a word."""
    hashes, starts, ends, bounds = ar.words(ar.LOWER[data], offsets)
    if not len(hashes):
        zero = np.zeros(0, np.int64)
        return hashes, zero, zero, zero, np.zeros(len(offsets), np.int64)
    # A word begins a line if its row begins, a line break stands before it or the word before it ends a sentence.
    breaks = np.append(0, np.cumsum(BREAK[data]))
    begins = np.ones(len(hashes), bool)
    begins[1:] = (breaks[starts[1:]] > breaks[ends[:-1]]) | STOP[data[ends[:-1] - 1]]
    begins[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(hashes)))
    nth = np.arange(len(hashes)) - np.repeat(first, count)
    up, _ = ar.powers(int(count.max()) + 1)
    total = ar.mix(np.add.reduceat(hashes * up[nth], first) + count.astype(np.uint64))
    return total, count, starts[first], ends[first + count - 1], np.searchsorted(first, bounds)


def runs(hashes: np.ndarray, count: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first line, end line) of the shortest runs of ``least`` words from each line, forwards and backwards, inside its row."""
    total = np.append(0, np.cumsum(count, dtype=np.int64))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(hashes))
    end = np.searchsorted(total, total[:-1] + least)
    ahead = end <= bounds[1:][row]
    first = np.searchsorted(total, total[1:] - least, side="right") - 1
    back = first >= bounds[:-1][row]
    back[back] = end[first[back]] != at[back] + 1  # else the same run as forwards
    first, end = np.concatenate([at[ahead], first[back]]), np.concatenate([end[ahead], at[back] + 1])
    up, down = ar.powers(len(hashes) + 1)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64))
    return ar.mix((sums[end] - sums[first]) * down[first] ^ ar.mix((end - first).astype(np.uint64))), first, end


def sequences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, fp, hashes, words, runs) for every row with a doc_id and a line; fp tells rows with one doc_id apart.

    runs has the distinct keys of the row's runs of ``least`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, offsets, data in ar.text_slices(batch.column(2)):
                h, count, _, _, at = lines(data, offsets)
                key, first, _ = runs(h, count, at, least)
                key = key[np.argsort(first, kind="stable")].view(np.int64)
                of = np.searchsorted(np.sort(first), at)
                found += [(h[a:b].view(np.int64), count[a:b].astype(np.int32), np.unique(key[c:d])) for a, b, c, d in zip(at[:-1], at[1:], of[:-1], of[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([h for h, _, _ in found], pa.list_(pa.int64())),
                pa.array([c for _, c, _ in found], pa.list_(pa.int32())), pa.array([r for _, _, r in found], pa.list_(pa.int64())),
            ], ["doc_id", "fp", "hashes", "words", "runs"])

    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text")
    return rows.mapInArrow(ar.tidy(run), "doc_id long, fp long, hashes array<long>, words array<int>, runs array<long>").filter("size(hashes) > 0")


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first place, whose second places increase."""
    tails, at, before = [], [], [-1] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [j], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks (place in a, place in b, lines), in order."""
    matched: dict[int, int] = {}
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {h: j for j, h in enumerate(b[b0:b1], b0) if in_b[h] == 1}
        anchors = _increasing([(i, place[h]) for i, h in enumerate(a[a0:a1], a0) if in_a[h] == 1 and h in place])
        if not anchors:  # nothing unique is left: what agrees at either end
            i, j = a0, b0
            while i < a1 and j < b1 and a[i] == b[j]:
                matched[i] = j
                i, j = i + 1, j + 1
            x, y = a1, b1
            while x > i and y > j and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
                matched[x] = y
            continue
        i, j = a0, b0
        for p, q in [*anchors, (a1, b1)]:
            if p < i or q < j:  # already reached by growing from the anchor before
                continue
            x, y = p, q
            while x > i and y > j and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
                matched[x] = y
            todo.append((i, x, j, y))
            i, j = p, q
            while i < a1 and j < b1 and a[i] == b[j]:
                matched[i] = j
                i, j = i + 1, j + 1
    blocks: list[tuple[int, int, int]] = []
    for i in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == matched[i]:
            blocks[-1] = (blocks[-1][0], blocks[-1][1], blocks[-1][2] + 1)
        else:
            blocks.append((i, matched[i], 1))
    return blocks


def _keys(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(hashes.view(np.uint64), words, np.array([0, len(hashes)]), least)


def shared_lines(own: np.ndarray, words: np.ndarray, other: np.ndarray, other_words: np.ndarray, least: int) -> np.ndarray:
    """Which lines of ``own`` are in an aligned block of ``least`` words that ``other`` has too.

    The whole texts are aligned first. An alignment keeps one order and one partner of each line, so
    what it left is aligned again where a run of it stands in ``other``: with the lines around
    both places, then the run alone, until no run with a line that is left is common.
    """
    gone = np.zeros(len(own), bool)
    a, b = own.tolist(), other.tolist()

    def align(p: int, q: int, x: int, y: int) -> None:
        for i, _, n in patience(a[p:q], b[x:y]):
            if words[p + i : p + i + n].sum() >= least:
                gone[p + i : p + i + n] = True

    align(0, len(a), 0, len(b))
    if gone.all():
        return gone
    key, first, end = _keys(own, words, least)
    there, start, stop = _keys(other, other_words, least)
    order = np.argsort(there, kind="stable")
    at = order[np.minimum(np.searchsorted(there[order], key), len(there) - 1)] if len(there) else np.zeros(len(key), np.int64)
    common = np.flatnonzero(there[at] == key) if len(there) else np.zeros(0, np.int64)
    for around in (AROUND, 0):
        for k in common:
            p, q, x, y = first[k], end[k], start[at[k]], stop[at[k]]
            if not gone[p:q].all():
                align(max(0, p - around), min(len(a), q + around), max(0, x - around), min(len(b), y + around))
    return gone


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(k) for k in ("hashes", "words", "other", "other_words")]
            for i in range(batch.num_rows):
                gone = shared_lines(*(c[i].values.to_numpy() for c in columns), least)
                out.append(np.flatnonzero(np.diff(gone, prepend=False, append=False)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "fp", "cuts"])

    return run


def common_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, fp, cuts): for each later document the lines to delete, as pairs of first and end."""
    # Both sides of the joins below are written tables, so that a run or a first document with
    # a large share of all rows is split over tasks.
    s = runtime.write_scratch(sequences(docs, block_words).dropDuplicates(["doc_id", "fp"]), "lines")
    runs_of = s.select("doc_id", "fp", F.explode("runs").alias("h"))
    holders = runs_of.groupBy("h").agg(F.min(F.struct("doc_id", "fp")).alias("first"), F.count("*").alias("k")).filter("k > 1")
    holders = runtime.write_scratch(holders.select("h", "first"), "holders")
    pairs = runs_of.join(holders, "h").filter("doc_id <> first.doc_id").select("doc_id", "fp", "first").distinct()
    pairs = pairs.select("doc_id", "fp", F.col("first.doc_id").alias("b_id"), F.col("first.fp").alias("b_fp"))
    held = s.select(F.col("doc_id").alias("b_id"), F.col("fp").alias("b_fp"), F.col("hashes").alias("other"), F.col("words").alias("other_words"))
    both = pairs.join(held, ["b_id", "b_fp"]).select("doc_id", "fp", "other", "other_words")
    both = both.join(s, ["doc_id", "fp"])
    cuts = both.select("doc_id", "fp", "hashes", "words", "other", "other_words").mapInArrow(ar.tidy(_align(block_words)), "doc_id long, fp long, cuts array<int>").filter("size(cuts) > 0")
    return runtime.write_scratch(cuts.groupBy("doc_id", "fp").agg(F.flatten(F.collect_list("cuts")).alias("cuts")), "cuts")


def _cut_text(raw: bytes, cuts: np.ndarray, spans: tuple) -> tuple[str, int, int]:
    """(text without the lines named, lines deleted, their words)."""
    count, start, end = spans
    gone = np.zeros(len(start) + 1, np.int64)
    for a, b in cuts.reshape(-1, 2):
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    kept, at, i = [], 0, 0
    while i < len(start):
        if gone[i]:
            kept.append(raw[at : start[i]])
            while i < len(start) and gone[i]:
                i += 1
            at = start[i] if i < len(start) else end[-1]
        else:
            i += 1
    kept.append(raw[at:])
    text = b"".join(kept).decode()
    return text.strip() if gone[-1] or gone.all() else text, int(gone.sum()), int(count[gone].sum())


def _apply(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    out: list = []
    for lo, hi, offsets, data in ar.text_slices(texts):
        _, count, start, end, at = lines(data, offsets)
        for i in range(lo, hi):
            a, b, base = at[i - lo], at[i - lo + 1], offsets[i - lo]
            if not cuts[i].is_valid or a == b:
                out.append((texts[i].as_py(), int(b - a), 0, 0))
            else:
                raw = data[base : offsets[i - lo + 1]].tobytes()
                spans = count[a:b], start[a:b] - base, end[a:b] - base
                text, gone, words = _cut_text(raw, cuts[i].values.to_numpy(), spans)
                out.append((text, int(b - a), gone, words))
    names = ("text", "n_lines", "n_removed", "removed_words")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.StructArray.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], list(names))


def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS, into: str = "deduped") -> DataFrame:
    """All columns of ``docs``, with one more, named by ``into``: (text, n_lines, n_removed, removed_words).

    Documents are ordered by doc_id, so of two that share a block the one with the larger
    doc_id loses it. Rows without a doc_id or a text stay as they are (a null text has no
    lines), and so do several rows of one doc_id among themselves. A text that
    loses nothing is returned byte for byte; one that loses all its lines becomes empty.
    """
    runtime.ship_package(docs.sparkSession)
    # Texts go to Python and come back; a batch of the default 10,000 rows would hold them many times over.
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(docs.sparkSession.conf.get(rows))
    docs.sparkSession.conf.set(rows, str(now if 0 < now < BATCH_ROWS else BATCH_ROWS))
    cuts = common_blocks(docs, block_words)
    size = cuts.agg(F.sum(F.lit(48) + 4 * F.size("cuts"))).first()[0] or 0
    names = [F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), F.col("cuts").alias("_cuts")]
    side = cuts.select(*names)
    if size <= runtime.BROADCAST_BYTES // 2:
        side = F.broadcast(side)

    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            yield _apply(texts, found)

    # Not deterministic in name only: a filter on the result must not evaluate it a second time.
    apply = arrow_udf(ar.tidy(apply), "text string, n_lines long, n_removed long, removed_words long").asNondeterministic()
    on = (docs["doc_id"].cast("long") == side["_id"]) & (F.xxhash64(docs["text"]) == side["_fp"])
    joined = docs.join(side, on, "left")
    return joined.select(*[docs[c] for c in docs.columns if c != into], apply(docs["text"], side["_cuts"]).alias(into))
