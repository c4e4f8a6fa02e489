"""Texts scored by an interpolated modified Kneser-Ney bigram model.

Counting is two shuffles of packed blocks: words by hash range, then pairs of a word
and its predecessor by the predecessor. Predecessors that are frequent enough to fill a
task are known from the first count, and their pairs are spread by both words. Each
reducer writes its part of the model, sorted hashes beside their counts, into
the shared folder; workers map these files into memory and probe them with sorted
queries. A worker holds none of the model beyond the pages it touches.

For a word w after v, with the discounts D of the two levels:

    p(w|v) = max(c(vw) - D, 0) / c(v) + gamma(v) * p(w)
    p(w)   = max(n(w) - D, 0) / n + gamma / (V + 1)

where c counts occurrences, n(w) the distinct predecessors of w, n their sum, V the
distinct words of the training texts; what is not known shares the last term.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell import runtime
from siftwell.llm import arrays as ar

U64 = np.uint64
# Hashes that stand for the start of a text, which is no token, and for its end, which is one.
START, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Tokens that are combined or scored at a time; words per part looked at for heavy predecessors.
TOKENS, HEAVIEST = 1 << 19, 64
WORD_COLUMNS = ("count", "before", "one", "two", "more")  # occurrences; distinct predecessors; successors seen once, twice, more


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return ar.mix(v * U64(3) + w)


def _streams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens with ends, first token by row) of consecutive rows, about TOKENS at a time."""
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    begin = None

    def flush(end: int):
        tokens, size = np.concatenate(held), np.concatenate(sizes)
        first = np.cumsum(size) - size
        full = np.empty(len(tokens) + len(size), U64)
        stop = first + size + np.arange(len(size))
        place = np.ones(len(full), bool)
        place[stop] = False
        full[place], full[stop] = tokens, END
        return begin, end, full, first + np.arange(len(size))

    for lo, hi, offsets, data in ar.text_slices(texts):
        h, _, _, bounds = ar.words(ar.LOWER[data], offsets)
        begin = lo if begin is None else begin
        held.append(h)
        sizes.append(np.diff(bounds))
        if sum(map(len, held)) >= TOKENS or hi == len(texts):
            yield flush(hi)
            held, sizes, begin = [], [], None


def _before(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    v = np.empty_like(tokens)
    v[1:] = tokens[:-1]
    v[first] = START
    return v


def _dealt(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), order[cuts[p] : cuts[p + 1]]


def _packed(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(c.tobytes() for c in columns)


def _unpacked(block: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(block, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(block, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _gathered(blocks: pa.ChunkedArray | list, *kinds) -> list[np.ndarray]:
    parts = [_unpacked(b if isinstance(b, bytes) else b.as_py(), *kinds) for b in blocks]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]


def _summed(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, with the sums of the columns."""
    if not len(keys):
        return [keys, *columns]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return [keys[first], *(np.add.reduceat(c[order].astype(np.int64), first) for c in columns)]


def _record(rows: list[tuple], kind: str = "part int, kind int, block binary") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "block"])


BLOCKS = "part int, kind int, block binary"


def _count_words(parts: int):
    def run(batches):
        for batch in batches:
            for _, _, tokens, _ in _streams(batch.column(0)):
                words, counts = np.unique(tokens, return_counts=True)
                part = (words % U64(parts)).astype(np.int64)
                yield _record([(p, 0, _packed(words[o], counts[o].astype(np.uint32))) for p, o in _dealt(part, parts)])

    return run


def _sum_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One block of word counts (kind 0) and one of the heaviest, the sum and the number of ends (kind 1)."""
    words, counts = _summed(*_gathered(table.column("block"), U64, np.uint32))
    top = np.argsort(-counts, kind="stable")[:HEAVIEST]
    rows = [(key[0].as_py(), 0, _packed(words, counts)), (key[0].as_py(), 1, _packed(np.append(words[top], [U64(0), END]), np.append(counts[top], [counts.sum(), counts[words == END].sum()])))]
    return pa.Table.from_batches([_record(rows)])


def _count_pairs(parts: int, heavy: np.ndarray):
    def run(batches):
        for batch in batches:
            for _, _, w, first in _streams(batch.column(0)):
                v = _before(w, first)
                order = np.lexsort((w, v))
                v, w = v[order], w[order]
                new = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
                counts = np.diff(np.append(new, len(v)))
                v, w = v[new], w[new]
                part = np.where(np.isin(v, heavy), _pair_hash(v, w), v) % U64(parts)
                rows = []
                for p, o in _dealt(part.astype(np.int64), parts):
                    names, begin = np.unique(v[o], return_index=True)  # sorted within a part: a predecessor is named once
                    many = np.diff(np.append(begin, len(o)))
                    rows.append((p, 0, _packed(names, many.astype(np.uint32)) + _packed(w[o], counts[o].astype(np.uint32))))
                yield _record(rows)

    return run


def _store(folder: str, name: str, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    """Write sorted keys and columns as one file, which appears whole or not at all."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(_packed(keys, *columns))
    fs.move(own, f"{path}/{name}")


_mapped: dict[str, np.memmap] = {}


def _open(folder: str, name: str, *kinds) -> list[np.ndarray]:
    """Keys and columns of a stored file, mapped into memory; from a remote store it is first copied beside the worker."""
    full = f"{folder}/{name}"
    if full not in _mapped:
        fs, path = pyarrow.fs.FileSystem.from_uri(full) if ":" in full else (pyarrow.fs.LocalFileSystem(), full)
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):
            handle, near = tempfile.mkstemp()
            os.close(handle)
            pyarrow.fs.copy_files(path, near, source_filesystem=fs, destination_filesystem=pyarrow.fs.LocalFileSystem())
            _mapped[full] = np.memmap(near, np.uint8, "r")
            os.unlink(near)  # the map keeps it
        else:
            _mapped[full] = np.memmap(path, np.uint8, "r")
    return _unpacked(_mapped[full], *kinds)


def _sum_pairs(parts: int, folder: str):
    """Store the pairs of one part; hand on what they say about predecessors (kind 2), words (kind 3) and counts of counts (kind 4)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, vs, ws, cs = key[0].as_py(), [], [], []
        for block in table.column("block"):
            raw = block.as_py()
            names, many = _unpacked(raw, U64, np.uint32)
            w, c = _unpacked(raw[8 + 12 * len(names) :], U64, np.uint32)
            vs.append(np.repeat(names, many))
            ws.append(w)
            cs.append(c)
        v, w, c = np.concatenate(vs), np.concatenate(ws), np.concatenate(cs)
        order = np.lexsort((w, v))
        v, w, c = v[order], w[order], c[order]
        new = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        c = np.add.reduceat(c.astype(np.int64), new)
        v, w = v[new], w[new]
        h = _pair_hash(v, w)
        order = np.argsort(h)
        _store(folder, f"pairs-{part}", h[order], [np.minimum(c, 65535)[order].astype(np.uint16)])
        large = order[c[order] >= 65535]
        _store(folder, f"large-{part}", h[large], [c[large]])
        out = []
        names, one, two, more = _summed(v, c == 1, c == 2, c > 2)
        for p, o in _dealt((names % U64(parts)).astype(np.int64), parts):
            out.append((p, 2, _packed(names[o], one[o].astype(np.uint32), two[o].astype(np.uint32), more[o].astype(np.uint32))))
        names, before = _summed(w, np.ones(len(w), np.int64))
        for p, o in _dealt((names % U64(parts)).astype(np.int64), parts):
            out.append((p, 3, _packed(names[o], before[o].astype(np.uint32))))
        out.append((0, 4, _packed(np.bincount(np.minimum(c, 5), minlength=6))))
        return pa.Table.from_batches([_record(out)])

    return run


def _sum_facts(folder: str):
    """Store the words of one part; return the counts of counts of distinct predecessors and their sum."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        by: dict[int, list[bytes]] = {0: [], 2: [], 3: []}
        for kind, block in zip(table.column("kind").to_pylist(), table.column("block")):
            by[kind].append(block.as_py())
        words, counts = _gathered(by[0], U64, np.int64)
        v, one, two, more = _gathered(by[2], U64, np.uint32, np.uint32, np.uint32)
        w, before = _gathered(by[3], U64, np.uint32)
        zero = [np.zeros(len(x), np.int64) for x in (words, v, w)]
        names, count, before, one, two, more = _summed(
            np.concatenate([words, v, w]), np.concatenate([counts, zero[1], zero[2]]), np.concatenate([zero[0], zero[1], before]),
            *(np.concatenate([zero[0], x, zero[2]]) for x in (one, two, more)))
        _store(folder, f"words-{key[0].as_py()}", names, [x.astype(np.int64) for x in (count, before, one, two, more)])
        facts = np.append(np.bincount(np.minimum(before, 5), minlength=6), [before.sum(), np.count_nonzero(count)])
        return pa.Table.from_batches([_record([(key[0].as_py(), 5, _packed(facts.astype(np.int64)))])])

    return run


def _discounts(n: np.ndarray) -> np.ndarray:
    """D for a count of 1, 2 and more, from how many counts are 1, 2, 3 and 4; fit for tables too small for the formula."""
    n1, n2, n3, n4 = (float(x) for x in n[1:5])
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(d, [0.05, 0.05, 0.05], [1.0, 2.0, 3.0])


@dataclass
class LanguageScorer:
    """Where the model's files are, and its few global numbers."""

    folder: str
    parts: int
    heavy: np.ndarray
    n_tokens: int
    n_texts: int
    vocabulary: int
    predecessors: int
    pair_discounts: np.ndarray = field(default_factory=lambda: np.zeros(3))
    word_discounts: np.ndarray = field(default_factory=lambda: np.zeros(3))
    word_kinds: np.ndarray = field(default_factory=lambda: np.zeros(3))  # words with 1, 2, more predecessors

    def _probe(self, name: str, part: np.ndarray, keys: np.ndarray, kinds: list) -> list[np.ndarray]:
        """Columns of sorted ``keys``, 0 where a key is unknown."""
        out = [np.zeros(len(keys), np.int64) for _ in kinds]
        for p, o in _dealt(part.astype(np.int64), self.parts):
            held, *columns = _open(self.folder, f"{name}-{p}", U64, *kinds)
            if len(held):
                at = np.minimum(np.searchsorted(held, keys[o]), len(held) - 1)
                same = held[at] == keys[o]
                for x, column in zip(out, columns):
                    x[o[same]] = column[at[same]]
        return out

    def score(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) by row."""
        words, place = np.unique(np.append(tokens, START), return_inverse=True)
        count, before, one, two, more = self._probe("words", words % U64(self.parts), words, [np.int64] * 5) if self.n_tokens else np.zeros((5, len(words)), np.int64)
        base = np.log10((count + 0.1) / (self.n_tokens + 0.1 * (self.vocabulary + 1)))
        uniform = 1 / (self.vocabulary + 1)
        d = np.append(0, self.word_discounts)
        rest = (self.word_discounts @ self.word_kinds) / self.predecessors if self.predecessors else 1.0
        single = np.maximum(before - d[np.minimum(before, 3)], 0) / max(1, self.predecessors) + rest * uniform
        total = np.where(words == START, self.n_texts, count)
        gamma = np.where(total > 0, (self.pair_discounts @ np.stack([one, two, more])) / np.maximum(1, total), 1.0)
        own, v = place[:-1], np.empty(len(tokens), np.int64)
        v[1:], v[first] = own[:-1], place[-1]
        pair = _pair_hash(words[v], tokens)
        part = np.where(np.isin(words, self.heavy)[v], pair, words[v]) % U64(self.parts)
        order = np.argsort(pair)
        c = np.zeros(len(tokens), np.int64)
        if self.n_tokens:
            c[order] = self._probe("pairs", part[order], pair[order], [np.uint16])[0]
            top = np.flatnonzero(c == 65535)
            if len(top):
                c[top] = self._probe("large", part[top], pair[top], [np.int64])[0]
        d = np.append(0, self.pair_discounts)
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(1, total[v]) + gamma[v] * single[own]
        return (np.add.reduceat((count[own] > 0).astype(np.int64), first), np.add.reduceat(base[own], first), np.add.reduceat(np.log10(p), first))


def fit_model(docs: DataFrame) -> LanguageScorer:
    """Count all of ``docs`` (``text``; null is an empty text) and store the model in the shared folder."""
    spark = docs.sparkSession
    runtime.ship_package(spark)
    folder = runtime.scratch_path(spark, "bigrams")
    parts = min(65536, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    texts = docs.select("text")
    words = texts.mapInArrow(_count_words(parts), BLOCKS).groupBy("part").applyInArrow(_sum_words, BLOCKS)
    words = runtime.write_scratch(words, "words")
    heavy, n_tokens, n_texts = [], 0, 0
    for r in words.filter("kind = 1").select("block").collect():  # at most HEAVIEST words of each part
        w, c = _unpacked(bytes(r["block"]), U64, np.int64)
        n_tokens += int(c[-2])
        n_texts += int(c[-1])
        heavy.append((w[:-2], c[:-2]))
    names, counts = (np.concatenate(x) for x in zip(*heavy)) if heavy else (np.zeros(0, U64), np.zeros(0))
    names = np.append(names[counts * 4 * parts > n_tokens], START)
    model = LanguageScorer(folder, parts, names, n_tokens, n_texts, 0, 0)
    if not n_tokens:
        return model
    pairs = texts.mapInArrow(_count_pairs(parts, names), BLOCKS).groupBy("part").applyInArrow(_sum_pairs(parts, folder), BLOCKS)
    pairs = runtime.write_scratch(pairs, "pairs")
    facts = words.filter("kind = 0").union(pairs.filter("kind in (2, 3)")).groupBy("part").applyInArrow(_sum_facts(folder), BLOCKS)
    counts = sum(_unpacked(bytes(r["block"]), np.int64)[0] for r in pairs.filter("kind = 4").select("block").collect())
    about = sum(_unpacked(bytes(r["block"]), np.int64)[0] for r in facts.select("block").collect())
    model.pair_discounts, model.word_discounts = _discounts(counts), _discounts(about)
    model.word_kinds = np.array([about[1], about[2], about[3:6].sum()], float)
    model.predecessors, model.vocabulary = int(about[6]), int(about[7])
    # Parts without a word or a pair have no file yet.
    for p in range(parts):
        for name, kinds in (("words", [np.int64] * 5), ("pairs", [np.uint16]), ("large", [np.int64])):
            _store_missing(folder, f"{name}-{p}", kinds)
    return model


def _store_missing(folder: str, name: str, kinds: list) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    if fs.get_file_info(f"{path}/{name}").type == pyarrow.fs.FileType.NotFound:
        _store(folder, name, np.zeros(0, U64), [np.zeros(0, k) for k in kinds])


def score_texts(docs: DataFrame, model: LanguageScorer) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``doc_id``, ``text``; null is an empty text, which has its end alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = []
            for _, _, tokens, first in _streams(batch.column(1)):
                size = np.diff(np.append(first, len(tokens)))
                found.append((size, *shared.value.score(tokens, first)))
            if found:
                columns = [np.concatenate(x) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
