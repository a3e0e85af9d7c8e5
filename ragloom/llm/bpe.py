"""Byte-level BPE encoding and decoding with rank files, on padded numpy matrices.

The pieces of a block of texts are encoded once each. Pieces of similar length form a padded matrix of
token ids; in every round each row merges its leftmost pair of minimum rank, ranks come from a hashed
pair table, and rows that have no pair left leave the matrix. Longer pieces than the widest matrix go
through a heap with the same pair table, so that a text without any break costs n·log n.
"""

from __future__ import annotations

import base64
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.pieces import KNOWN, Known, split_by, split_known
from ragloom.llm.textwords import U, blocks, word_hashes

_NONE = np.int32(0x7FFFFFFF)
#: Widest matrix in bytes, cells of a matrix, and distinct pieces kept between blocks.
WIDEST, CELLS, KEPT = 256, 1 << 18, 100_000


class Ranks:
    """A rank file: base64 token and rank on each line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.byte = np.full(256, -1, np.int32)
        for b in range(256):
            self.byte[b] = self.rank[bytes([b])]
        size = max(self.rank.values()) + 1
        token = [b""] * size
        for t, r in self.rank.items():
            token[r] = t
        self.length = np.array([len(t) for t in token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        left, right, whole = [], [], []
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a = self.rank.get(t[:i])
                b = self.rank.get(t[i:]) if a is not None else None
                if b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(r)
        self._table(np.array(left, U), np.array(right, U), np.array(whole, np.int32))

    def _table(self, left: np.ndarray, right: np.ndarray, whole: np.ndarray) -> None:
        """Open addressing with linear probing; at most a quarter full."""
        bits = max(8, int(4 * max(1, len(left))).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, U(2**64 - 1))
        self.values = np.full(1 << bits, _NONE)
        key = (left << U(32)) | right
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == U(2**64 - 1)
            taken, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[taken], self.values[taken] = key[put], whole[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or a number above all ranks; negative ids are padding."""
        key = (left.astype(np.int64).view(U) << U(32)) | (right.astype(np.int64).view(U) & U(0xFFFFFFFF))
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found != U(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != U(2**64 - 1))]
        return out

    def _matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        n = len(rows)
        size = np.array([len(r) for r in rows])
        ids = np.full((n, width), np.int32(-1))
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = self._ranks(ids)
        out: list[np.ndarray | None] = [None] * n
        who = np.arange(n)
        columns = np.arange(width - 1)
        while len(who):
            at = ranks.argmin(1)
            row = np.arange(len(who))
            low = ranks[row, at]
            done = low == _NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[who[r]] = ids[r, : size[r]].copy()
                live = ~done
                who, ids, ranks, size, at, low = who[live], ids[live], ranks[live], size[live], at[live], low[live]
                row = np.arange(len(who))
                if not len(who):
                    break
            size = size - 1
            ids[row, at] = low
            # what stands right of the merged pair moves one place left
            take = columns + (columns > at[:, None])
            ids[:, :-1] = np.where(columns <= at[:, None], ids[:, :-1], np.take_along_axis(ids, np.minimum(columns + 1, width - 1)[None, :].repeat(len(who), 0), 1))
            ids[:, -1] = -1
            ranks[:, :-1] = np.take_along_axis(ranks, take[:, :-1], 1)
            ranks[:, -1] = _NONE
            ranks[row, at] = self._beside(ids, row, at, size)
            prev = at > 0
            ranks[row[prev], at[prev] - 1] = self._beside(ids, row[prev], at[prev] - 1, size[prev])
            most = int(size.max())
            if most < ids.shape[1] - 1 and most > 1:  # compact the columns too
                width = most + 1
                ids, ranks, columns = ids[:, :width].copy(), ranks[:, : width - 1].copy(), np.arange(width - 1)
        return out

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        left, right = ids[:, :-1].ravel(), ids[:, 1:].ravel()
        out = np.full(len(left), _NONE)
        real = np.flatnonzero(right >= 0)
        out[real] = self.pair(left[real], right[real])
        return out.reshape(len(ids), -1)

    def _beside(self, ids: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.full(len(row), _NONE)
        real = np.flatnonzero(at + 1 < size)
        out[real] = self.pair(ids[row[real], at[real]], ids[row[real], at[real] + 1])
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        first = self.pair(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != _NONE)]
        heapq.heapify(heap)
        current = first.tolist() + [int(_NONE)]
        none = int(_NONE)

        def rank(i: int) -> int:
            j = after[i]
            if j >= n:
                return none
            return self._one(ids[i], ids[j])

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or current[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            current[j] = none
            for k in (i, before[i]):
                if k >= 0:
                    current[k] = rank(k)
                    if current[k] != none:
                        heapq.heappush(heap, (current[k], k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _one(self, a: int, b: int) -> int:
        key = (a << 32) | b
        slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while True:
            found = int(self.keys[slot])
            if found == key:
                return int(self.values[slot])
            if found == 2**64 - 1:
                return int(_NONE)
            slot = (slot + 1) & self.mask

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > WIDEST:
                out[i] = self._heap(p)
            else:
                by.setdefault(len(p) if len(p) <= 16 else -(-len(p) // 16) * 16, []).append(i)
        for width, members in by.items():
            step = max(1, CELLS // width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after another."""
        size = self.length[ids]
        end = np.cumsum(size)
        at = np.repeat(self.start[ids] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        return self.bytes[at].tobytes()


@cache
def ranks(path: str, pattern: str) -> Ranks:
    """Read once per worker."""
    return Ranks(path, pattern)


class Encoder:
    """Encodes blocks of texts, keeping the ids of up to KEPT distinct pieces by a 64-bit hash of theirs."""

    def __init__(self, table: Ranks):
        self.table = table
        self.kept = Known(KEPT)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block of texts, one after another, and the offset of each text's first id."""
        if self.table.pattern.pattern == KNOWN:
            starts = split_known(data, offsets)
            ends = np.append(starts[1:], len(data))[: len(starts)]
        else:
            starts, ends = split_by(self.table.pattern, data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        hashes, index, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        begin, end = starts[index], ends[index]
        slots = self.kept.slots(hashes, lambda new: self.table.encode_pieces([raw[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)]))
        ids, size = self.kept.joined(slots[inverse])
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]


def encoding(path: str, pattern: str, text_at: str, ids_at: str):
    """Batches with the ids of their texts added; null texts count as empty."""

    def run(batches):
        encoder = Encoder(ranks(path, pattern))
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(text_at)):
                ids, at = encoder.block(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids_at])

    return run


def decoding(path: str, pattern: str, ids_at: str, bytes_at: str):
    """Batches with the bytes of their ids added; null ids count as none."""

    def run(batches):
        table = ranks(path, pattern)
        for batch in batches:
            out = [table.decode(np.asarray(x.values)) if x.is_valid else b"" for x in batch.column(ids_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, bytes_at])

    return run


def _apply(df: DataFrame, column: str, cast: str, make, into: str, kind: str) -> DataFrame:
    names = {c: f"c{i}" for i, c in enumerate(df.columns) if c != into}  # apart from any name of the input
    part = df.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(column).cast(cast).alias("x"))
    schema = ", ".join([*(f"{n} {part.schema[n].dataType.simpleString()}" for n in names.values()), f"x {cast}", f"y {kind}"])
    out = part.mapInArrow(make("x", "y"), schema)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("y").alias(into))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """The rows and columns of the input with `into`, the token ids (array<int>) of the whole text.

    Each match of `pattern` is encoded by itself, by the ranks in the file at `path`, without special tokens. Null and
    empty texts have no ids. A column already named `into` is replaced.
    """
    return _apply(df, text_col, "string", lambda x, y: encoding(path, pattern, x, y), into, "array<int>")


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows and columns of the input with `into`, the bytes (binary) of the ids; null and empty ids give no bytes."""
    return _apply(df, ids_col, "array<int>", lambda x, y: decoding(path, pattern, x, y), into, "binary")


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode and decode in one Python stage, so that a task needs one worker and ids do not cross to the JVM between them."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns) if c not in (ids, decoded)}  # apart from any name of the input
    part = df.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(text_col).cast("string").alias("x"))
    to_ids, to_bytes = encoding(path, pattern, "x", "y"), decoding(path, pattern, "y", "z")

    def run(batches):
        for batch in to_bytes(to_ids(batches)):
            yield batch.select([*names.values(), "y", "z"])

    schema = ", ".join([*(f"{n} {part.schema[n].dataType.simpleString()}" for n in names.values()), "y array<int>, z binary"])
    out = part.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("y").alias(ids), F.col("z").alias(decoded))
