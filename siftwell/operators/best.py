"""The best rows of each of very many queries, kept while a task streams its input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Tasks that each return rows for a query, at most; what they return is shuffled once.
MOST_GROUPS = 32


def groups(df: DataFrame) -> int:
    """Tasks to stream ``df`` with: two a core, so that one that takes long leaves others to do, up to MOST_GROUPS."""
    return max(1, min(MOST_GROUPS, 2 * df.sparkSession.sparkContext.defaultParallelism))


class BestRows:
    """Running best ``k`` rows of ``n`` queries under (key, id); a NULL id comes first.

    Its size is fixed by the queries, whatever a task has seen.
    """

    def __init__(self, n: int, k: int):
        self.k = k
        self.key = np.full((n, k), np.inf)
        self.value, self.id = np.zeros((n, k)), np.zeros((n, k), np.int64)
        self.null = np.zeros((n, k), bool)

    @property
    def limit(self) -> np.ndarray:
        """The key of the ``k``-th row, infinite where a query has fewer."""
        return self.key[:, -1]

    def add(self, rows: np.ndarray, ids: np.ndarray, value: np.ndarray, key: np.ndarray, null: np.ndarray | None = None) -> None:
        """Offer ``ids[i]`` to query ``rows[i]``."""
        if not len(rows):
            return
        null = np.zeros(len(rows), bool) if null is None else null
        touched, at = np.unique(rows, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        columns = [
            np.concatenate([held[touched].reshape(-1), new])
            for held, new in ((self.key, key), (self.value, value), (self.id, ids), (self.null, null))
        ]
        order = np.lexsort((columns[2], ~columns[3], columns[0], q))
        # Every query has k places at least, so the first k of each are a matrix.
        first = np.searchsorted(q[order], np.arange(len(touched)))
        keep = order[(first[:, None] + np.arange(self.k)).reshape(-1)]
        for held, column in zip((self.key, self.value, self.id, self.null), columns):
            held[touched] = column[keep].reshape(len(touched), self.k)

    def filled(self) -> np.ndarray:
        """Which places hold a row."""
        return np.isfinite(self.key)
