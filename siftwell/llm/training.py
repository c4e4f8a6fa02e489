"""Bounded labelled samples for classifiers, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most. Of each it sees the whole text.
SAMPLE_ROWS = 6000


def held_out(column: str, mod: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod ``mod`` is ``remainder``; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % mod == remainder, F.lit(True))


def chosen_rows(labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label, rank) of at most ``rows`` rows, uniform over the labelled rows that ``learn`` allows.

    labels: ``doc_id`` and ``label``. Rows are chosen by a hash of doc_id, before any text is read. Null
    labels and doc_ids teach nothing. The same table gives the same rows.
    """
    known = labels.select("doc_id", "label").filter(learn & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    rank = F.xxhash64("doc_id", F.lit(17))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    bound = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    return known.withColumn("rank", rank).filter(F.col("rank") <= F.lit(bound)).orderBy("rank", "doc_id", "label").limit(rows)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(rank, label, text): the whole text of each chosen row, one also where a doc_id repeats; a null text teaches nothing.

    The chosen ids (a bounded list) find their texts without a shuffle of others.
    """
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("rank", "label").agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> list[tuple[bytes, object]]:
    """(text bytes, label) of ``chosen_rows``, in a fixed order."""
    got = texts_of(docs, chosen_rows(labels, learn, rows)).collect()
    found = sorted(((r["rank"], r["text"].encode(), r["label"]) for r in got), key=lambda r: (r[0], r[1], str(r[2])))
    return [(raw, label) for _, raw, label in found]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the last for a constant, by Newton's method with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
