"""Language by a byte convolutional network, trained and run in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed
length, each keeps its maximum, and a softmax over the maxima names the
language. A filter of width w is a sum of w table look-ups, because an embedded
byte times a filter slice depends on the byte alone; that is the form used to
predict. A text is cut into windows over its whole length; the probabilities of
its windows, weighted by their bytes, are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siftwell import runtime
from siftwell.llm import arrays as ar
from siftwell.llm import training

# Bytes of a window, filter widths, filters of each width, size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 8
#: Windows computed at a time, so that the work stays in a core's cache.
BATCH = 32
UNKNOWN = "und"


@dataclass
class LanguageModel:
    names: list[str]
    tables: list[np.ndarray] = field(default_factory=list)  # one of (width, 256, FILTERS) for each width
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Maxima of all filters for windows (n, WINDOW) of bytes."""
        found = []
        for width, table in zip(WIDTHS, self.tables):
            n = WINDOW - width + 1
            total = table[0].take(x[:, :n], axis=0)
            for k in range(1, width):
                total += table[k].take(x[:, k : k + n], axis=0)
            found.append(total.max(axis=1))
        return np.maximum(np.concatenate(found, axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if len(self.names) < 2:
            return np.ones((len(x), max(1, len(self.names))))
        parts = [self.pooled(x[i : i + BATCH]) for i in range(0, len(x), BATCH)]
        z = np.concatenate(parts) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, its bytes): every row is cut into windows; the last one is filled with zeros."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][row] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[1:][row] - start)
    padded = np.append(ar.LOWER[data], np.zeros(WINDOW, np.uint8))
    at = start[:, None] + np.arange(WINDOW)
    x = padded[at]
    x[np.arange(WINDOW) >= length[:, None]] = 0
    return x, row, length


def fit_language(sample: list[tuple[bytes, str]], epochs: int = 4, batch: int = 64, rate: float = 0.01) -> LanguageModel:
    """Train on all windows of the sample by Adam. Without any label every text has no known language."""
    model = LanguageModel(sorted({y for _, y in sample}))
    if len(model.names) < 2:
        return model
    rng = np.random.default_rng(0)
    xs, ys = [], []
    for raw, label in sample:
        data = np.frombuffer(raw, np.uint8)
        if len(data):
            x, _, _ = windows(data, np.array([0, len(data)]))
            xs.append(x)
            ys.append(np.full(len(x), model.names.index(label)))
    x, y = np.concatenate(xs), np.concatenate(ys)
    n_classes, n_filters = len(model.names), FILTERS * len(WIDTHS)
    # Windows of rare languages count for more, half way to equal classes.
    weight = (len(y) / n_classes / np.bincount(y, minlength=n_classes)) ** 0.5
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "b": np.zeros(n_filters), "o": rng.normal(0, 0.3, (n_filters, n_classes)), "ob": np.zeros(n_classes)}
    p |= {f"w{w}": rng.normal(0, 0.5 / np.sqrt(w), (w, EMBED, FILTERS)) for w in WIDTHS}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            pick = order[lo : lo + batch]
            xb, yb, n = x[pick], y[pick], len(pick)
            tables = {w: np.einsum("be,wef->wbf", p["e"], p[f"w{w}"]) for w in WIDTHS}
            tops, where = [], {}
            for w in WIDTHS:
                total = sum(tables[w][k].astype(np.float32).take(xb[:, k : WINDOW - w + 1 + k], axis=0) for k in range(w))
                where[w] = total.argmax(axis=1)
                tops.append(np.take_along_axis(total, where[w][:, None, :], 1)[:, 0])
            pre = np.concatenate(tops, axis=1) + p["b"]
            h = np.maximum(pre, 0)
            z = h @ p["o"] + p["ob"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), yb] -= 1
            z *= weight[yb][:, None] / n
            g = {"o": h.T @ z, "ob": z.sum(0), "e": np.zeros_like(p["e"])}
            dh = (z @ p["o"].T) * (pre > 0)
            g["b"] = dh.sum(0)
            for j, w in enumerate(WIDTHS):
                d = dh[:, j * FILTERS : (j + 1) * FILTERS]
                g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
                for k in range(w):
                    byte = np.take_along_axis(xb, where[w] + k, 1).astype(np.int64)
                    dt = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), d.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                    g["e"] += dt @ p[f"w{w}"][k].T
                    g[f"w{w}"][k] = p["e"].T @ dt
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.tables = [np.einsum("be,wef->wbf", p["e"], p[f"w{w}"]).astype(np.float32) for w in WIDTHS]
    model.bias, model.out, model.out_bias = (p[k].astype(np.float32) for k in ("b", "o", "ob"))
    return model


def language_model(docs: DataFrame, rows: int = training.SAMPLE_ROWS) -> LanguageModel:
    """A model fitted on the whole texts of at most ``rows`` documents with a language whose crc32(doc_id) mod 5 is not 0."""
    runtime.ship_package(docs.sparkSession)
    known = docs.select("doc_id", F.col("lang").alias("label"))
    return fit_language(training.labelled_sample(docs, known, ~training.held_out("doc_id", 5, 0), rows))


def _predict(model: LanguageModel, texts: pa.Array) -> pa.Array:
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for lo, hi, offsets, data in ar.text_slices(texts):
        x, row, length = windows(data, offsets)
        p = model.probabilities(x) * length[:, None]
        total = np.stack([np.bincount(row, c, hi - lo) for c in p.T], axis=1)
        total /= np.maximum(1, np.diff(offsets))[:, None]
        best[lo:hi], score[lo:hi] = total.argmax(axis=1), total.max(axis=1)
    known = letters & bool(model.names)
    names = np.array(model.names or [UNKNOWN], object)
    return pa.StructArray.from_arrays(
        [pa.array(np.where(known, names[best], UNKNOWN), pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], ["lang_pred", "score"])


def predict_language(docs: DataFrame, model: LanguageModel, into: str = "language") -> DataFrame:
    """All columns of ``docs`` and one named by ``into`` (lang_pred string, score double), from the text alone.

    A null text, or one without a letter, is ``und`` with score 0. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _predict(shared.value, texts)

    return docs.withColumn(into, predict(F.col("text")))
