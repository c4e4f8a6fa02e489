"""SentencePiece encoding and decoding in batched numpy.

A text is cut where a piece cannot reach across (before a run of spaces and around line
breaks); the distinct cuttings of a batch, here called words, are grouped by their
number of characters, so that words of equal length advance together in one matrix.
The hash of every substring of up to the longest piece's length is probed in the
sorted hashes of the pieces, which gives one table of scores for each group. On it runs

* for a unigram model the Viterbi search: for every end the best start is a
  vectorised maximum over piece lengths, kept as a backpointer;
* for a BPE model the merges its definition prescribes: in every round each word
  joins its best pair, the leftmost of equals, found as a vectorised maximum.
  The path of the highest total score is not what a BPE model encodes to.

Characters without a piece become bytes if the model has byte pieces, else the unknown
piece. Decoding joins the bytes of the pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siftwell import runtime
from siftwell.llm import arrays as ar

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the format: the mark of a space, types of pieces, types of models.
SPACE, NORMAL, UNKNOWN, BYTE, USER, UNIGRAM, BPE = 0x2581, 1, 2, 6, 4, 1, 2
#: Cells of a score table at a time; characters above which a word is cut, and merged with a queue where it can't be;
#: characters of a long word that are looked up at a time; bytes of a slice.
CELLS, LONG, STRETCH, SLICE = 1 << 19, 96, 1 << 14, 1 << 20
U64 = np.uint64
NONE = np.float32(-np.inf)


@dataclass
class PieceModel:
    """Vocabulary as arrays; it is as large as the vocabulary and travels with the tasks."""

    kind: int
    dummy_prefix: bool
    pieces: list[bytes]  # what each id decodes to, spaces as spaces
    scores: np.ndarray
    keys: np.ndarray  # sorted hashes of the pieces that texts can contain
    key_ids: np.ndarray
    longest: int
    byte_ids: np.ndarray  # id of each byte, or the unknown id
    unknown: int
    is_byte: np.ndarray

    def __post_init__(self) -> None:
        self.score_of = np.append(self.scores, NONE)  # -1, no piece, is the last
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> U64(44)).astype(np.int64)] = True
        self.lengths = np.array([len(p) for p in self.pieces])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 for none."""
        out = np.full(hashes.shape, -1, np.int32)
        some = np.flatnonzero(self.seen[(hashes >> U64(44)).astype(np.int64)])
        h = hashes.ravel()[some]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        out.ravel()[some] = np.where(self.keys[at] == h, self.key_ids[at], -1)
        return out


def _prefix_sums(points: np.ndarray) -> np.ndarray:
    up, _ = ar.powers(points.shape[1] + 1)
    sums = np.zeros((len(points), points.shape[1] + 1), U64)
    np.cumsum((points.astype(U64) + U64(1)) * up[:-1], axis=1, out=sums[:, 1:])
    return sums


def _hash_points(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all substrings of ``length``, from the prefix sums of the rows of a matrix of code points."""
    _, down = ar.powers(sums.shape[1])
    return ar.mix((sums[:, length:] - sums[:, :-length]) * down[: sums.shape[1] - length] + U64(length))


def load_model(path: str = MODEL_FILE) -> PieceModel:
    """Read a model file. Models whose normaliser rewrites characters are refused."""
    from sentencepiece import sentencepiece_model_pb2 as format_of

    proto = format_of.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with the identity normaliser are supported")
    return make_model([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type, proto.normalizer_spec.add_dummy_prefix)


def make_model(table: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True) -> PieceModel:
    """A model from (piece, score, type) rows."""
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is not supported")
    unknown = next(i for i, t in enumerate(table) if t[2] == UNKNOWN)
    byte_ids = np.full(256, unknown, np.int32)
    held, keys, ids, longest = [], [], [], 1
    for i, (piece, _, what) in enumerate(table):
        if what == BYTE:
            byte_ids[int(piece[3:5], 16)] = i
            held.append(bytes([int(piece[3:5], 16)]))
        elif what in (NORMAL, USER):
            held.append(piece.replace(chr(SPACE), " ").encode())
            points = np.array([[ord(c) for c in piece]])
            longest = max(longest, points.shape[1])
            keys.append(int(_hash_points(_prefix_sums(points), points.shape[1])[0, 0]))
            ids.append(i)
        else:
            held.append(" ⁇ ".encode() if what == UNKNOWN else b"")
    order = np.argsort(np.array(keys, U64))
    return PieceModel(kind, dummy_prefix, held, np.array([t[1] for t in table], np.float32), np.array(keys, U64)[order], np.array(ids, np.int32)[order],
                      longest, byte_ids, unknown, np.array([t[2] == BYTE for t in table]))


def _tables(model: PieceModel, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the substrings (word, start, length - 1); -1 and -inf where there is no piece."""
    n, size = points.shape
    most = min(size, model.longest)
    ids, sums = np.full((n, size, most), -1, np.int32), _prefix_sums(points)
    for length in range(1, most + 1):
        ids[:, : size - length + 1, length - 1] = model.look_up(_hash_points(sums, length))
    return ids, model.score_of.take(ids, mode="wrap")


def _merge(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, start) of the tokens that merging leaves, in order, for words of one length."""
    n, size, most = scores.shape
    flat = scores.reshape(-1)
    who, starts = np.arange(n), np.tile(np.arange(size + 1), (n, 1))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(who):
        left, end = starts[:, :-2], starts[:, 2:]
        if left.shape[1] == 0:
            done.append((who, starts[:, :-1]))
            break
        length = end - left
        value = flat[(who[:, None] * size + left) * most + np.minimum(length, most) - 1]
        value = np.where(length <= most, value, NONE)
        best = value.argmax(axis=1)
        open_ = value[np.arange(len(who)), best] > NONE
        if not open_.all():
            done.append((who[~open_], starts[~open_, :-1]))
            who, starts, best = who[open_], starts[open_], best[open_]
        keep = np.arange(starts.shape[1]) != (best + 1)[:, None]
        starts = starts[keep].reshape(len(who), starts.shape[1] - 1)
    word = np.concatenate([np.repeat(w, s.shape[1]) for w, s in done])
    start = np.concatenate([s.ravel() for _, s in done])
    order = np.argsort(word, kind="stable")
    return word[order], start[order]


def _merge_long(model: PieceModel, points: np.ndarray) -> list[int]:
    """Token starts of one long word, by a queue of pairs."""
    ids, scores = _tables(model, points[None])
    size, most = len(points), scores.shape[2]
    end, before, alive, heap = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size, []

    def offer(i: int) -> None:
        j = end[i]
        if j < size and end[j] - i <= most and scores[0, i, end[j] - i - 1] > NONE:
            heapq.heappush(heap, (-float(scores[0, i, end[j] - i - 1]), i, j, end[j]))

    for i in range(size):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if alive[i] and alive[j] and end[i] == j and end[j] == k:
            alive[j], end[i] = False, k
            if k < size:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
    return [i for i in range(size) if alive[i]]


def _viterbi(model: PieceModel, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, start) of the tokens on the best path; of equal paths the one whose last piece is longest."""
    n, size, most = scores.shape
    missing = model.scores[model.key_ids].min() - 10
    # By end instead of start, the longest piece first: what an end compares lies side by side.
    by_end = np.full((n, size + 1, most), -np.inf)
    for length in range(2, most + 1):
        by_end[:, length:, most - length] = scores[:, : size - length + 1, length - 1]
    by_end[:, 1:, most - 1] = np.where(ids[:, :, 0] < 0, missing, scores[:, :, 0])
    best, back, rows = np.zeros((n, size + 1)), np.zeros((n, size + 1), np.int64), np.arange(n)
    for end in range(1, size + 1):
        reach = min(end, most)
        value = best[:, end - reach : end] + by_end[:, end, most - reach :]
        pick = value.argmax(axis=1)
        best[:, end], back[:, end] = value[rows, pick], end - reach + pick
    word, start, who, end = [], [], rows, np.full(n, size)
    while len(who):
        begin = back[who, end]
        word.append(who)
        start.append(begin)
        who, end = who[begin > 0], begin[begin > 0]
    word, start = np.concatenate(word), np.concatenate(start)
    # Tokens were found from the last to the first.
    order = np.argsort(word[::-1], kind="stable")
    return word[::-1][order], start[::-1][order]


def _uncrossed(model: PieceModel, points: np.ndarray) -> np.ndarray:
    """Places inside a long word that no piece reaches across; either kind of model cuts there."""
    size, crossed = len(points), np.zeros(len(points) + 1, np.int64)
    for lo in range(0, size, STRETCH):
        ids, _ = _tables(model, points[None, lo : lo + STRETCH + model.longest])
        start, more = np.nonzero(ids[0, : STRETCH, 1:] >= 0)
        np.add.at(crossed, lo + start + 1, 1)
        np.add.at(crossed, lo + start + more + 2, -1)
    return np.flatnonzero(np.cumsum(crossed)[1:size] == 0) + 1


def _cut_long(model: PieceModel, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, word of each part) of the words with the long ones cut where no piece reaches across."""
    cuts = [bounds[i] + _uncrossed(model, points[bounds[i] : bounds[i + 1]]) for i in np.flatnonzero(np.diff(bounds) > LONG)]
    if not cuts:
        return bounds, np.arange(len(bounds) - 1)
    new = np.union1d(bounds, np.concatenate(cuts))
    return new, np.searchsorted(bounds, new[:-1], side="right") - 1


def _encode_words(model: PieceModel, points: np.ndarray, bounds: np.ndarray, kinds: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, counts) of distinct words by each kind of model; word i has the code points bounds[i] to bounds[i+1]."""
    parts, owner = _cut_long(model, points, bounds)
    sizes = np.diff(parts)
    found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in kinds]
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        step = max(1, CELLS // int(size * min(size, model.longest)))
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            matrix = points[parts[some][:, None] + np.arange(size)]
            ids, scores = _tables(model, matrix)
            for kind, out in zip(kinds, found):
                if kind == UNIGRAM:
                    word, start = _viterbi(model, ids, scores)
                elif size <= LONG:
                    word, start = _merge(scores)
                else:
                    held = [_merge_long(model, row) for row in matrix]
                    word, start = np.repeat(np.arange(len(some)), [len(h) for h in held]), np.concatenate(held).astype(np.int64)
                last = np.append(word[1:] != word[:-1], True)
                length = np.where(last, size, np.append(start[1:], 0)) - start
                out.append((some[word], start, ids[word, start, length - 1]))
    every = []
    for out in found:
        word, start, ids = (np.concatenate(c) for c in zip(*out))
        order = np.argsort(word, kind="stable")
        ids, counts = _with_bytes(model, points, parts, word[order], start[order], ids[order])
        every.append((ids, np.bincount(owner, counts, len(bounds) - 1).astype(np.int64)))
    return every


def _with_bytes(model: PieceModel, points: np.ndarray, bounds: np.ndarray, word: np.ndarray, start: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts by word), with characters that have no piece as their bytes or as the unknown piece."""
    lone = np.flatnonzero(ids < 0)
    if len(lone):
        chars = [chr(c).encode() if model.byte_ids.max() != model.unknown or c == -1 else b"\0" for c in points[bounds[word[lone]] + start[lone]]]
        counts = np.ones(len(ids), np.int64)
        counts[lone] = [len(c) for c in chars]
        at = np.cumsum(counts) - counts
        word, ids = np.repeat(word, counts), np.repeat(ids, counts)
        new = model.byte_ids[np.frombuffer(b"".join(chars), np.uint8)]
        ids[np.concatenate([np.arange(a, a + n) for a, n in zip(at[lone], counts[lone])])] = new
    return ids.astype(np.int32), np.bincount(word, minlength=len(bounds) - 1)


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, byte place) of the characters of UTF-8 bytes; a space is its mark."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int32)
    lead, a, b, c = padded[at], padded[at + 1] & 63, padded[at + 2] & 63, padded[at + 3] & 63
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 31) << 6 | a, np.where(lead < 0xF0, (lead & 15) << 12 | a << 6 | b, (lead & 7) << 18 | a << 12 | b << 6 | c)))
    return np.where(point == 32, SPACE, point), at


def encode_slice(model: PieceModel, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds by row) of the texts of a slice."""
    return encode_both(model, offsets, data, (model.kind,))[0]


def encode_both(model: PieceModel, offsets: np.ndarray, data: np.ndarray, kinds: tuple[int, ...] = (BPE, UNIGRAM)) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for several kinds of model over the same pieces, from one table of substring scores."""
    sizes = np.diff(offsets)
    if model.dummy_prefix:  # a space before every text that is not empty
        filled = sizes > 0
        shift = np.cumsum(filled)
        wide = np.full(len(data) + int(filled.sum()), 32, np.uint8)
        wide[np.arange(len(data)) + np.repeat(shift, sizes)] = data
        offsets, data = offsets + np.append(0, shift), wide
    if not len(data):
        return [(np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)) for _ in kinds]
    blank, newline = data == 32, data == 10
    cut = newline.copy()
    cut[1:] |= newline[:-1] | (blank[1:] & ~blank[:-1])
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    _, first, place = np.unique(ar.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends[first] - starts[first]
    begin = np.cumsum(size) - size
    own = data[np.arange(size.sum()) + np.repeat(starts[first] - begin, size)]
    points, at = _code_points(own)
    out = []
    for ids, counts in _encode_words(model, points, np.searchsorted(at, np.append(begin, len(own))), kinds):
        held = np.cumsum(counts) - counts
        many = counts[place]
        total = np.cumsum(many)
        of_rows = ids[np.arange(total[-1]) + np.repeat(held[place] - (total - many), many)]
        out.append((of_rows, np.append(0, total)[np.searchsorted(starts, offsets)]))
    return out


def decode_slice(model: PieceModel, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of rows of ids; the space that encoding put first is taken away."""
    size = model.lengths[ids]
    total = np.append(0, np.cumsum(size))
    raw = model.bytes[np.arange(total[-1]) + np.repeat(model.places[ids] - total[:-1], size)].tobytes()
    out = []
    for a, b in zip(total[bounds[:-1]], total[bounds[1:]]):
        text = raw[a:b].decode(errors="replace")
        out.append(text[1:] if model.dummy_prefix and text[:1] == " " else text)
    return out


def encoder(docs: DataFrame, model: PieceModel):
    """A column function: text to array<int>. Null stays null, an empty text has no ids."""
    runtime.ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("array<int>")
    @ar.tidy
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for _, _, offsets, data in ar.text_slices(texts, SLICE):
                ids, bounds = encode_slice(shared.value, offsets, data)
                parts.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)))
            found = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
            yield pa.array(found.to_pylist(), pa.list_(pa.int32()), mask=texts.is_null().to_numpy(False)) if texts.null_count else found

    return encode


def decoder(docs: DataFrame, model: PieceModel):
    """A column function: array<int> to text. Null stays null."""
    runtime.ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("string")
    @ar.tidy
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            out: list = []
            for lo in range(0, len(rows), 256):
                some = rows.slice(lo, 256)
                counts = np.array([len(r) if r.is_valid else 0 for r in some], np.int64)
                texts = decode_slice(shared.value, some.flatten().to_numpy(False), np.append(0, np.cumsum(counts)))
                out += [t if ok else None for t, ok in zip(texts, some.is_valid().to_pylist())]
            yield pa.array(out, pa.string())

    return decode


def path_scores(model: PieceModel, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the scores of each row's pieces; what has no piece counts as in the search."""
    missing = float(model.scores[model.key_ids].min() - 10)
    lost = model.is_byte[ids] | (ids == model.unknown)
    # The bytes of one character count once: those that continue it are free.
    first = (model.bytes[np.minimum(model.places[ids], len(model.bytes) - 1)] & 0xC0) != 0x80
    value = np.where(lost, np.where(first | ~model.is_byte[ids], missing, 0.0), model.scores[ids].astype(np.float64))
    total = np.append(0.0, np.cumsum(value))
    return total[bounds[1:]] - total[bounds[:-1]]


def digest(docs: DataFrame, model: PieceModel) -> Column:
    """Of each text, null counting as empty: (n_tokens, n_byte_tokens, ids_crc32 of the ids as little-endian 32-bit numbers,
    round_trip) of the model's own encoding, and (n_viterbi, viterbi_crc32, viterbi_score) of the path of the
    highest total score over the same pieces, which for a unigram model is the same path."""
    import zlib

    runtime.ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "n_viterbi", "viterbi_crc32", "viterbi_score")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())

    @arrow_udf("n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean, n_viterbi long, viterbi_crc32 long, viterbi_score double")
    @ar.tidy
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            rows: list[tuple] = []
            for _, _, offsets, data in ar.text_slices(texts, SLICE):
                (ids, bounds), (best, ends) = encode_both(model, offsets, data, (model.kind, UNIGRAM))
                scores = path_scores(model, best, ends)
                raw, as_bytes = data.tobytes(), np.append(0, np.cumsum(model.is_byte[ids]))
                for i, text in enumerate(decode_slice(model, ids, bounds)):
                    a, b, c, d = bounds[i], bounds[i + 1], ends[i], ends[i + 1]
                    same = text.encode(errors="replace") == raw[offsets[i] : offsets[i + 1]].replace(chr(SPACE).encode(), b" ")
                    rows.append((b - a, as_bytes[b] - as_bytes[a], zlib.crc32(ids[a:b].tobytes()), same, d - c, zlib.crc32(best[c:d].tobytes()), round(scores[i], 4)))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))

    return measure(F.col("text"))
