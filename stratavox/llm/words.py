"""Words and hashes of texts as NumPy arrays, straight from Arrow's UTF-8 buffers.

A batch is cut into pieces of about ``PIECE`` bytes (a longer text is a piece of
its own), so the arrays of a task stay small whatever the batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a piece, and rows that are looked at together at most; bytes up to which a worker keeps its tables of powers (16 bytes for each).
PIECE, ROWS = 1 << 18, 1024
KEPT = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

#: ASCII white space of the contracts: space and 0x09 to 0x0D.
SPACE_WORDS = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: Digits, lower-case letters and all bytes of non-ASCII characters, after A-Z are lower-cased.
ALNUM_WORDS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER_VALUES = _VALUES[_LOWER]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        made = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.multiply.accumulate(row))
        if size > KEPT:  # for one long text only: workers live on
            return made[0], made[1]
        _powers = made[0], made[1]
    return _powers


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of rows; row i of a run is bytes[bounds[i]:bounds[i + 1]]. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for first in range(0, len(column), ROWS):
        wide = column.slice(first, ROWS).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
        data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] else np.zeros(0, np.uint8)
        row = 0
        while row < len(wide):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
            end = min(end, len(wide))
            yield first + row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


Batches = Iterator[pa.RecordBatch]


def returning(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, which gives freed memory back to the system when a task ends: workers live on beside those of other stages."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def word_spans(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each row the number of words before it (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, scattered; A-Z as a-z if ``lower``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER_VALUES if lower else _VALUES)[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by where it starts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    found = words[:size].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            found *= np.uint64(0xD6E8FEB86659FD93)
            found += words[k : k + size]
    return mix(found)


def shingle_sets(words: np.ndarray, counts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct n-word shingles; of fewer words, the whole sequence as one; of none, nothing."""
    windows = window_hashes(words, n)
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= n:
            row = np.sort(windows[a : b - n + 1])
            keep = np.ones(len(row), bool)
            keep[1:] = row[1:] != row[:-1]
            yield row[keep]
        elif b > a:
            yield window_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield windows[:0]
