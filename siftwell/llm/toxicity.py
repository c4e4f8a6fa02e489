"""Toxicity by a bidirectional gated recurrent network over overlapping windows.

The input of a step is a word: its embedding, if the word is in the vocabulary
of the sample, beside the sum of embeddings of its character pairs, which every
word has. Two gated recurrent units read a window forwards and backwards,
attention pools their states, and a logistic unit gives the window's score.
Windows overlap and cover the whole text; a text is scored by its most toxic
window and by the mean over windows, calibrated on texts the network has not
seen. Everything is numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siftwell import runtime
from siftwell.llm import arrays as ar
from siftwell.llm import training

# Words of a window and from one window to the next, sizes of the word and
# character embeddings and of the states, buckets of character pairs, words of the vocabulary.
WINDOW, STRIDE = 32, 24
WORD, CHAR, STATE, ATTEND, PAIRS, VOCABULARY = 8, 6, 8, 8, 4096, 20000
BATCH = 512
#: Labelled rows that are used, at most, and one in how many of them calibrates.
SAMPLE_ROWS, CALIBRATE = 3000, 5
U64 = np.uint64
#: Characters of a word that are letters; a word is blank-separated and trimmed of ASCII punctuation.
EDGE = np.zeros(256, bool)
EDGE[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(vocabulary hashes, (character pairs, first pair of each word), bounds by row) of the words of rows."""
    data = ar.LOWER[data]
    starts, ends = ar.spans(~(ar.BLANK | EDGE)[data], offsets)
    return ar.span_hashes(data, starts, ends), char_pairs(data, starts, ends), np.searchsorted(starts, offsets)


def char_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs of neighbouring bytes of each word, ends included, and where each word's begin."""
    length = ends - starts + 1
    begin = np.cumsum(length) - length
    at = np.arange(length.sum()) + np.repeat(starts - begin, length)
    padded = np.append(data, np.uint8(32)).astype(np.int32)
    left, right = padded[at - 1], padded[at]
    left[begin], right[begin + length - 1] = 0, 0
    return ((left * 167 + right * 13) % PAIRS).astype(np.uint16), begin


def char_sums(table: np.ndarray, pairs: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of the embeddings of the pairs of each word."""
    return np.add.reduceat(table.take(pairs, axis=0), begin, axis=0) if len(begin) else np.zeros((0, table.shape[1]), np.float32)


def window_index(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index of each step of each window, row): -1 fills rows of fewer words; the last window ends with the row."""
    sizes = np.diff(bounds)
    counts = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // STRIDE) + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.minimum(nth * STRIDE, np.maximum(0, sizes[row] - WINDOW))
    steps = begin[:, None] + np.arange(WINDOW)
    return np.where(steps < sizes[row][:, None], bounds[:-1][row][:, None] + steps, -1), row


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def gru(x: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, n, STATE) for projected inputs (steps, n, 3 * STATE)."""
    h = np.zeros((x.shape[1], STATE), x.dtype)
    out = np.empty((len(x), x.shape[1], STATE), x.dtype)
    for t in range(len(x)):
        zr = _sigmoid(x[t, :, : 2 * STATE] + h @ u[:, : 2 * STATE])
        z, r = zr[:, :STATE], zr[:, STATE:]
        c = np.tanh(x[t, :, 2 * STATE :] + (r * h) @ u[:, 2 * STATE :])
        new = h + z * (c - h)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((h, z, r, c))
        h = out[t] = new
    return out


def gru_back(dout: np.ndarray, keep: list, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    dx, du, dh = np.empty(dout.shape[:2] + (3 * STATE,)), np.zeros_like(u), np.zeros(dout.shape[1:])
    for t in range(len(dout) - 1, -1, -1):
        h, z, r, c = keep[t]
        g = dh + dout[t]
        live = g * mask[t][:, None]
        dz, dc = live * (c - h) * z * (1 - z), live * z * (1 - c * c)
        dm = dc @ u[:, 2 * STATE :].T
        dr = dm * h * r * (1 - r)
        dzr = np.hstack([dz, dr])
        dx[t] = np.hstack([dzr, dc])
        du += np.hstack([h.T @ dzr, (r * h).T @ dc])
        dh = (g - live) + live * (1 - z) + dm * r + dzr @ u[:, : 2 * STATE].T
    return dx, du


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted word hashes
    p: dict[str, np.ndarray]
    calibration: np.ndarray
    trained: bool = True

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary, 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def logits(self, hashes: np.ndarray, spot: tuple, index: np.ndarray) -> np.ndarray:
        """One logit for each window."""
        p = self.p
        chars = char_sums(p["chars"], *spot)
        inputs = np.hstack([p["words"].take(self.word_ids(hashes), axis=0), chars])
        sides = [np.vstack([inputs @ p["x" + d] + p["b" + d], np.zeros((1, 3 * STATE), np.float32)]) for d in "fb"]
        out = np.empty(len(index))
        for lo in range(0, len(index), BATCH):
            at = index[lo : lo + BATCH].T
            mask = at >= 0
            full = mask.all()
            f = gru(sides[0].take(at, axis=0, mode="wrap"), None if full else mask, p["uf"])
            b = gru(sides[1].take(at[::-1], axis=0, mode="wrap"), None if full else mask[::-1], p["ub"])[::-1]
            h = np.concatenate([f, b], axis=2)
            a = np.tanh(h @ p["a"] + p["ab"]) @ p["v"]
            if not full:
                a = np.where(mask, a, -1e9)
            a = np.exp(a - a.max(axis=0))
            a /= a.sum(axis=0)
            out[lo : lo + BATCH] = np.einsum("tn,tnh->nh", a, h) @ p["o"] + p["ob"]
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        """(largest, mean) of the logits of each text's windows; a text without words has those of a clean one."""
        found = np.full((len(texts), 2), -4.0)
        for lo, hi, offsets, data in ar.text_slices(texts):
            hashes, spot, bounds = words_of(data, offsets)
            index, row = window_index(bounds)
            if not len(row):
                continue
            z = self.logits(hashes, spot, index)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            held = row[first]
            found[lo + held, 0] = np.maximum.reduceat(z, first)
            found[lo + held, 1] = np.add.reduceat(z, first) / np.diff(np.append(first, len(row)))
        return found

    def scores(self, texts: pa.Array) -> np.ndarray:
        return training.logistic(self.features(texts), self.calibration)


def _blank_model(vocabulary: np.ndarray, rng) -> ToxicityModel:
    size, both = WORD + CHAR, 2 * STATE
    p = {"words": rng.normal(0, 0.1, (len(vocabulary) + 1, WORD)), "chars": rng.normal(0, 0.1, (PAIRS, CHAR))}
    for d in "fb":
        p |= {"x" + d: rng.normal(0, size**-0.5, (size, 3 * STATE)), "b" + d: np.zeros(3 * STATE), "u" + d: rng.normal(0, STATE**-0.5, (STATE, 3 * STATE))}
    p |= {"a": rng.normal(0, both**-0.5, (both, ATTEND)), "ab": np.zeros(ATTEND), "v": rng.normal(0, ATTEND**-0.5, ATTEND), "o": rng.normal(0, both**-0.5, both), "ob": np.zeros(())}
    p["words"][0] = 0
    return ToxicityModel(vocabulary, p, np.array([1.0, 0.0, 0.0]))


def _sample_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, character pairs, first pair by word, bounds by text) of a sample, read in slices."""
    hashes, pairs, begins, sizes, at = [], [], [], [], 0
    for _, _, offsets, data in ar.text_slices(pa.array([t.decode(errors="replace") for t in texts])):
        h, (own, begin), bounds = words_of(data, offsets)
        hashes.append(h)
        pairs.append(own)
        begins.append(begin + at)
        sizes.append(np.diff(bounds))
        at += len(own)
    return np.concatenate(hashes), np.concatenate(pairs), np.concatenate(begins), np.append(0, np.cumsum(np.concatenate(sizes)))


def _logits_of(model: ToxicityModel, hashes: np.ndarray, pairs: np.ndarray, begin: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Logits of some windows of a sample, from the words that they span."""
    lo, hi = int(index[index >= 0].min()), int(index.max()) + 1
    first = begin[lo:hi]
    own = pairs[first[0] : begin[hi] if hi < len(begin) else len(pairs)]
    return model.logits(hashes[lo:hi], (own, first - first[0]), np.where(index >= 0, index - lo, -1))


def train_network(learn: list[tuple[bytes, int]], epochs: int = 3, batch: int = 128, rate: float = 0.01) -> ToxicityModel:
    """Train on all windows of the texts.

    A window takes its text's label; in a toxic text only the more toxic half of
    the windows is taken once the first epoch is over, since the rest may be clean.
    With one class only, or no words, the score is the share of toxic rows for every text.
    """
    rng = np.random.default_rng(0)
    y = np.array([int(v == 1) for _, v in learn], float)
    hashes, pairs, begin, bounds = _sample_words([t for t, _ in learn] or [b""])
    if not len(hashes) or y.min() == y.max():
        model = _blank_model(np.zeros(0, U64), rng)
        share = (y.sum() + 0.5) / (len(y) + 1)
        model.calibration, model.trained = np.array([0.0, 0.0, np.log(share / (1 - share))]), False
        return model
    owner = np.repeat(np.arange(len(learn)), np.diff(bounds))
    order = np.lexsort((owner, hashes))
    new = np.append(True, (np.diff(hashes[order]) != 0) | (np.diff(owner[order]) != 0))
    names, counts = np.unique(hashes[order][new], return_counts=True)  # in how many texts
    names, counts = names[counts > 2], counts[counts > 2]
    model = _blank_model(np.sort(names[np.argsort(-counts, kind="stable")[:VOCABULARY]]), rng)
    p, ids = model.p, model.word_ids(hashes)
    index, row = window_index(bounds)
    length = np.diff(np.append(begin, len(pairs)))
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, weight = 0, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    for epoch in range(epochs):
        if epoch:
            small = ToxicityModel(model.vocabulary, {k: a.astype(np.float32) for k, a in p.items()}, model.calibration)
            z = np.concatenate([_logits_of(small, hashes, pairs, begin, index[lo : lo + 4096]) for lo in range(0, len(row), 4096)])
            order = np.lexsort((-z, row))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            size = np.bincount(row, minlength=len(y))[row]
            used = order[(y[row] == 0) | (place < np.maximum(1, size // 2))]
        else:
            used = np.arange(len(row))
        used = rng.permutation(used)
        for lo in range(0, len(used), batch):
            at, yb, wb = index[used[lo : lo + batch]].T, y[row[used[lo : lo + batch]]], weight[row[used[lo : lo + batch]]]
            mask = at >= 0
            own, back = np.unique(at[mask], return_inverse=True)
            ragged = np.repeat(np.arange(len(own)), length[own])
            pair = pairs[np.arange(len(ragged)) - np.repeat(np.cumsum(length[own]) - length[own], length[own]) + begin[own][ragged]]
            chars = np.zeros((len(own), CHAR))
            for j in range(CHAR):
                chars[:, j] = np.bincount(ragged, p["chars"][pair, j], len(own))
            e = np.hstack([p["words"][ids[own]], chars])
            place = np.full(at.shape, -1)
            place[mask] = back
            sides, keeps, states = {}, {}, []
            for d in "fb":
                flip = slice(None, None, 1 if d == "f" else -1)
                x = np.vstack([e @ p["x" + d] + p["b" + d], np.zeros((1, 3 * STATE))])[place[flip]]
                keeps[d] = []
                states.append(gru(x, mask[flip], p["u" + d], keeps[d])[flip])
                sides[d] = flip
            h = np.concatenate(states, axis=2)
            s = np.tanh(h @ p["a"] + p["ab"])
            a = np.where(mask, s @ p["v"], -1e9)
            a = np.exp(a - a.max(axis=0))
            a /= a.sum(axis=0)
            pooled = np.einsum("tn,tnh->nh", a, h)
            dz = (_sigmoid(pooled @ p["o"] + p["ob"]) - yb) * wb / len(yb)
            g = {"o": pooled.T @ dz, "ob": dz.sum()}
            dp = dz[:, None] * p["o"]
            da = np.einsum("nh,tnh->tn", dp, h)
            da = a * (da - (a * da).sum(axis=0))
            ds = da[..., None] * p["v"] * (1 - s * s)
            g |= {"v": np.einsum("tn,tnk->k", da, s), "a": np.einsum("tnh,tnk->hk", h, ds), "ab": ds.sum((0, 1))}
            dh = a[..., None] * dp + ds @ p["a"].T
            de = np.zeros_like(e)
            for j, d in enumerate("fb"):
                flip = sides[d]
                dx, g["u" + d] = gru_back(dh[flip][..., j * STATE : (j + 1) * STATE], keeps[d], mask[flip], p["u" + d])
                flat = np.zeros((len(own) + 1, 3 * STATE))
                where = place[flip].ravel()
                for c in range(3 * STATE):
                    flat[:, c] = np.bincount(np.where(where < 0, len(own), where), dx[..., c].ravel(), len(own) + 1)
                flat = flat[:-1]
                g["x" + d], g["b" + d] = e.T @ flat, flat.sum(0)
                de += flat @ p["x" + d].T
            g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
            for c in range(WORD):
                g["words"][:, c] = np.bincount(ids[own], de[:, c], len(p["words"]))
            for c in range(CHAR):
                g["chars"][:, c] = np.bincount(pair, de[ragged, WORD + c], PAIRS)
            g["words"][0] = 0
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (1 - 0.8 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.p = {k: np.asarray(a, np.float32) for k, a in p.items()}
    return model


def calibrate(model: ToxicityModel, features: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """Weigh (largest, mean) of whole texts that the network has not seen."""
    if model.trained:
        model.calibration = training.fit_logistic(features, y, ridge=0.1)
    return model


def toxicity_model(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model fitted on at most ``rows`` labelled documents whose crc32(doc_id) mod 5 is not 0.

    The network learns from all windows of the whole texts of four fifths of them; the others are
    scored whole where they lie, and two numbers of each calibrate.
    """
    spark = docs.sparkSession
    runtime.ship_package(spark)
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    chosen = runtime.write_scratch(training.chosen_rows(known, ~training.held_out("doc_id", 5, 0), rows), "labelled-rows")
    held_back = F.pmod(F.xxhash64("rank"), F.lit(CALIBRATE)) == 0
    got = training.texts_of(docs, chosen.filter(~held_back)).collect()
    learn = sorted(((r["rank"], r["text"].encode(), r["label"]) for r in got), key=lambda r: (r[0], r[1], str(r[2])))
    model = train_network([(raw, label) for _, raw, label in learn])
    if not model.trained:
        return model
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.features(texts).tolist(), pa.list_(pa.float64()))

    rest = training.texts_of(docs, chosen.filter(held_back)).select("rank", "label", features("text").alias("f")).collect()
    rest = sorted((r["rank"], int(r["label"] == 1), *r["f"]) for r in rest)
    return calibrate(model, np.array([r[2:] for r in rest]).reshape(-1, 2), np.array([r[1] for r in rest], float))


def score_toxicity(docs: DataFrame, model: ToxicityModel, into: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and one named by ``into`` (0 to 1); null counts as an empty text. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.scores(texts), pa.float64())

    return docs.withColumn(into, score(F.col("text")))
