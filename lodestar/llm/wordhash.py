"""Vectorised words and word-window hashes for Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D (in UTF-8 these
bytes never occur inside another character).  A word's hash is a polynomial
over a table of random 64-bit values for bytes, taken from prefix sums over the
whole chunk; a window's hash is a polynomial over its words' hashes.  All
arithmetic is modulo 2^64 with a final mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18            # bytes of text hashed at a time (a longer text is one chunk)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = _TABLE[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]     # A-Z as a-z
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) of consecutive rows, about ``size`` bytes at a time; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    if column.null_count:          # a null may span bytes: give it none
        column = pa.array([x or "" for x in column.to_pylist()], pa.large_string())
        yield from chunks(column, size)
        return
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words and, per row, the index of its first word (one more at the end)."""
    inside = ~_SPACE[data]
    n = len(data)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]           # words end where rows do
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _TABLE)[data] * up[:len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive words (len(h) - k + 1 values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = _u64(int(_STEP) + 2 * salt)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * step + h[j:j + n]
    return mix(out + _u64(k * int(_BASE)))


def long_window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The same idea for large k, from prefix sums."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + _u64(salt * int(_STEP))) * up[:len(h)], dtype=np.uint64, out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n] + np.uint64(k))
