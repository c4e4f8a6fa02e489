"""Text batches as numpy arrays: words, word hashes, distinct shingles.

Arrow hands a batch of texts over as one byte buffer with offsets.  The helpers
here work on slices of that buffer of about a megabyte, so that their memory
does not depend on the batch; a longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
# An odd base of the rolling hash and the two multipliers of a 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: space and the controls 9 to 13.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Give memory that is free again back to the system, which allocators else keep for a worker's next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of an iterator of batches that releases memory when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """The same for a function of one group's key and table."""

    def wrapped(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            release()

    return wrapped


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n-1 and their inverses, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * MIX_1
    x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) of consecutive rows with about ``size`` bytes; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    at = np.frombuffer(at, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, at[lo : hi + 1] - at[lo], data[at[lo] : at[hi]]
        lo = hi


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross a row's end."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[1:-1]
    before = np.empty(n, bool)
    before[0], before[1:] = False, member[:-1]
    before[inner[inner < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, member[1:]
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, from prefix sums of one rolling hash."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw ^ mix((ends - starts).astype(U64)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds) of the blank-separated words; row i has words bounds[i] to bounds[i+1]."""
    starts, ends = spans(~BLANK[data], offsets)
    hashes = span_hashes(data, starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; fewer words count as one sequence, none as nothing."""
    n = len(hashes)
    if not n:
        return hashes
    width_here = min(width, n)
    total = np.full(n - width_here + 1, width_here, U64)
    for i in range(width_here):
        total = mix(total + hashes[i : n - width_here + 1 + i])
    return np.unique(total)


def content_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a sequence of word hashes: equal for equal sequences."""
    up, _ = powers(len(hashes) + 1)
    total = mix((hashes * up[: len(hashes)]).sum(dtype=U64)[None] + U64(len(hashes)))
    return int(total.view(np.int64)[0])
