"""Words of whole Arrow columns as numpy arrays: bounds, hashes and hashes of word n-grams."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are taken together up to about this many bytes.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64, 256, dtype=U)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 21:
            _POWERS[int(base)] = have
    return have[:n]


@cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with up to `limit` bytes, or one longer row."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    trim()


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each text's first word (one more entry than texts)."""
    space = _SPACE[data]
    solid = ~space
    first, last = solid.copy(), solid.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    begin, end = offsets[:-1], offsets[1:] - 1
    begin, end = begin[begin < len(data)], end[end >= 0]
    first[begin] = solid[begin]
    last[end] = solid[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):  # in runs of about BLOCK bytes, so that memory stays bounded
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        a, b = starts[i], ends[j - 1]
        total = np.zeros(b - a + 1, U)
        np.cumsum(_BYTE[data[a:b]] * powers(_BASE, b - a), out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * powers(_INVERSE, b - a)[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)
        i = j
    return mixed(out)


def gram_hashes(words: np.ndarray, n: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """A 64-bit hash of each n consecutive words, over all of `words` (texts' borders included)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for j in range(n):
        out *= U(base)
        out += words[j : j + m]
    return mixed(out)


def long_gram_hashes(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """As gram_hashes, in constant work per word whatever n is."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(U(base), len(words)), out=total[1:])
    return mixed((total[n:] - total[:-n]) * powers(U(pow(base, -1, 2**64)), m))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
