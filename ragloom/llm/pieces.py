"""Splits texts into the pieces that byte-level BPE encodes separately, and keeps what is known of each piece."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import regex

# fixed values: the published splitting pattern that the vectorised splitter implements; others go through `regex`
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# fixed values: Unicode White_Space
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@cache
def _classes(size: int) -> np.ndarray:
    """Letter, number, white space or other, by code point below `size`."""
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(size)], np.uint8)
    out[_WHITE] = _SPACE
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)


def split_known(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start bytes of the pieces of a block of texts, under KNOWN."""
    if not len(data):
        return np.zeros(0, np.int64)
    plain = not (data & 0x80).any()
    points = data if plain else code_points(data)
    n = len(points)
    if plain:
        at, edge = None, offsets
    else:
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        edge = np.searchsorted(at, offsets)
    kind = _classes(0x10000 if plain or points.max() < 0x10000 else 0x110000)[points]
    begin = np.zeros(n + 1, bool)
    begin[edge] = True  # the first point of each text, and the end
    run = begin.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    white = kind == _SPACE
    blank = points == 0x20
    start = run.copy()
    # a run that a blank precedes in its text takes that blank along
    after_blank = np.zeros(n + 1, bool)
    after_blank[1:n] = blank[:-1] & ~white[1:]
    after_blank &= ~begin
    start &= ~after_blank
    # the last of several white characters before other text is apart from those before it
    last = np.zeros(n + 1, bool)
    last[: n - 1] = white[:-1] & ~white[1:]
    last[:n] &= ~begin[1:]
    start |= last
    quote = np.flatnonzero((points == 0x27) & start[:n])
    if len(quote):
        pad = np.concatenate([points, np.zeros(3, points.dtype)])
        inside = lambda k: ~np.concatenate([begin, np.ones(3, bool)])[quote + k]
        one, two = pad[quote + 1], pad[quote + 2]
        short = inside(1) & np.isin(one, [ord(c) for c in "stmd"])
        long = inside(1) & inside(2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for hit, size in ((short, 2), (long, 3)):
            q = quote[hit]
            start[q + 1] = False
            ends = q + size
            start[ends] |= np.concatenate([kind, [_OTHER]])[ends] == _LETTER
    found = np.flatnonzero(start[:n])
    return found if plain else at[found]


def split_by(pattern: regex.Pattern, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the matches of any pattern."""
    raw, starts, ends = data.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        at = a
        text, done = raw[a:b].decode(), 0
        for m in pattern.finditer(text):
            at += len(text[done : m.start()].encode())
            starts.append(at)
            at += len(m[0].encode())
            ends.append(at)
            done = m.end()
    return np.array(starts, np.int64), np.array(ends, np.int64)


class Known:
    """An integer array for each hash met, up to a number of hashes and of integers; flat, so that whole blocks are looked up at once."""

    #: Integers kept between blocks.
    FLAT = 1 << 22

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.start, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.used = 0

    def slots(self, hashes: np.ndarray, make) -> np.ndarray:
        """The slot of each distinct hash; make(indices) gives the arrays of those not met before."""
        if (len(self.at) + len(hashes) > self.most or self.used > self.FLAT) and self.at:
            self.clear()
        get = self.at.get
        slot = np.array([get(h, -1) for h in hashes.tolist()], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            rows = make(new)
            first, n = len(self.at), len(new)
            size = np.array([len(r) for r in rows], np.int64)
            flat = np.concatenate(rows)
            self.start, self.size, self.flat = _room(self.start, first + n), _room(self.size, first + n), _room(self.flat, self.used + len(flat))
            self.start[first : first + n] = self.used + np.cumsum(size) - size
            self.size[first : first + n] = size
            self.flat[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            slot[new] = np.arange(first, first + n)
            self.at.update(zip(hashes[new].tolist(), range(first, first + n), strict=True))
        return slot

    def joined(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of the slots, one after another, and their sizes."""
        size = self.size[slots]
        end = np.cumsum(size)
        at = np.repeat(self.start[slots] - (end - size), size)
        at += np.arange(len(at))
        return self.flat[at], size


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])
