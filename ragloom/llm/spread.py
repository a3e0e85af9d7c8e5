"""Hashes of many documents, dealt over buckets as packed arrays.

A row of the shuffle holds thousands of hashes with the documents they come from, so that a billion
hashes cost some hundred thousand rows. Each bucket is then one numpy sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def bucket_count(hashes: int, each: int = 500_000) -> int:
    """Buckets such that each holds about `each` hashes, however many hashes there are: no bucket outgrows a task."""
    return int(min(2**31 - 1, max(12, -(-hashes // each))))


class Packer:
    """Collects (bucket, owner, payload arrays) and gives packed record batches."""

    def __init__(self, buckets: int, kinds: list[np.dtype], flush: int = 1 << 18):
        self.buckets, self.kinds, self.limit = buckets, kinds, flush
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, bucket: np.ndarray, owner: np.ndarray, *payload: np.ndarray) -> None:
        # numpy sorts 16-bit keys by radix
        self.parts.append((bucket.astype(np.uint16 if self.buckets <= 65_536 else np.uint32), owner, *payload))
        self.held += len(bucket)

    def full(self) -> bool:
        return self.held >= self.limit

    def batches(self):
        if not self.held:
            return
        bucket, owner, *payload = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, owner, payload = bucket[order], owner[order], [p[order] for p in payload]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        cut = np.concatenate([[0], cut, [len(bucket)]])
        ids, blobs = [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = owner[a:b]
            runs = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            counts = np.diff(np.append(runs, b - a)).astype(np.uint32)
            ids.append(int(bucket[a]))
            blobs.append(b"".join([np.uint32([len(runs), b - a]).tobytes(), own[runs].tobytes(), counts.tobytes(), *(p[a:b].astype(k, copy=False).tobytes() for p, k in zip(payload, self.kinds, strict=True))]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def unpacked(blobs: pa.ChunkedArray, kinds: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct owners, the owner index of every item, and the items' payload arrays."""
    owners, counts, items = [], [], [[] for _ in kinds]
    for x in blobs:
        raw = x.as_buffer()
        runs, n = np.frombuffer(raw, np.uint32, 2)
        at = 8
        owners.append(np.frombuffer(raw, U, runs, at))
        at += 8 * int(runs)
        counts.append(np.frombuffer(raw, np.uint32, runs, at))
        at += 4 * int(runs)
        for k, out in zip(kinds, items, strict=True):
            out.append(np.frombuffer(raw, k, n, at))
            at += int(n) * np.dtype(k).itemsize
    distinct, index = np.unique(np.concatenate(owners), return_inverse=True)
    return distinct, np.repeat(index.astype(np.uint32), np.concatenate(counts)), [np.concatenate(x) for x in items]


SCHEMA = "bucket int, blob binary"
