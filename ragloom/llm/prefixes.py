"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For byte-pair merges the tokens of a prefix end in exactly one token, and it is the one that may stand
after the last token of the shorter prefix it leaves: count[i] = count[i - len(token)] + 1. Whether two
tokens may stand side by side is decided by undoing their merges in falling rank (`beside`). A piece
vocabulary of the kind handled here never joins characters over the start of a word, so the programme
runs once for each distinct word (a run of blanks and what follows it) and a text's counts are sums.
Long words (texts without blanks) are cut into stretches that run together: each starts some characters
early, as if a text began there. Where its last tokens before the cut are those of the stretch before, and its
counts differ from that one's by a constant, all that follows is the same too; else it starts at other characters
before the cut, or goes on from what is known there.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.pieces import Known, code_points
from ragloom.llm.textwords import U, blocks, mixed, word_hashes

#: Distinct words kept between blocks, and words whose programme runs together.
KEPT, TOGETHER = 250_000, 20_000
#: Characters of a word that is cut into stretches, of a stretch, and of its early start at first; stretches that run together.
LONG, STRETCH, EARLY, ABREAST = 2_048, 256, 32, 1_024
_BLANK = 0x2581
_STEP = U(0x9E3779B97F4A7C15)
_EMPTY = U(2**64 - 1)


class Table:
    """64-bit keys to numbers, open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(4 * max(1, len(keys))).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == _EMPTY
            taken, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[taken], self.values[taken] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _STEP) >> self.shift).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The numbers, -1 where there is none."""
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out


def _chars_hash(points: np.ndarray) -> np.ndarray:
    return mixed(points.astype(U) + U(0x51ED270B27D4EB4F))


class Pieces:
    """A sentencepiece BPE model: merge order, the merge that makes each piece, and where bytes stand in."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        words = {model.id_to_piece(i): model.get_score(i) for i in normal}
        over = [w for w in words if chr(_BLANK) in w.lstrip(chr(_BLANK))]
        if over or not any(model.is_byte(i) for i in range(model.vocab_size())):
            raise ValueError("the model joins characters over the start of a word, or has no bytes to fall back on")
        # ranks: single characters first, then pieces in the order of their merges
        chars = sorted(w for w in words if len(w) == 1)
        self.words = chars + sorted((w for w in words if len(w) > 1), key=lambda w: -words[w])
        self.base = len(chars)
        self.rank = {w: i for i, w in enumerate(self.words)}
        self.longest = max(map(len, self.words))
        self.left, self.right = np.arange(len(self.words), dtype=np.int32), np.arange(len(self.words), dtype=np.int32)
        self.chars = Table(np.array([ord(c) for c in chars], U), np.arange(len(chars), dtype=np.int32))
        pairs: dict[tuple[int, int], int] = {}
        self.real = np.ones(len(self.words), bool)
        for r in range(self.base, len(self.words)):
            w = self.words[r]
            made = None
            for i in range(len(w) - 1, 0, -1):
                a, b = self.rank.get(w[:i]), self.rank.get(w[i:])
                if a is not None and b is not None and a < r and b < r and self.real[a] and self.real[b] and self._beside(pairs, a, b, r):
                    made = (a, b)
                    break
            if made is None:
                self.real[r] = False  # no order of merges ends in this piece
            else:
                pairs[made] = r
                self.left[r], self.right[r] = made
        self.pairs = Table(np.array([(a << 32) | b for a, b in pairs], U), np.array(list(pairs.values()), np.int32))
        keys, ranks_ = [], []
        for r in range(self.base, len(self.words)):
            if self.real[r]:
                keys.append(self._key(self.words[r]))
                ranks_.append(r)
        self.known = Table(np.array(keys, U), np.array(ranks_, np.int32))

    @staticmethod
    def _key(word: str) -> int:
        h = _chars_hash(np.array([ord(c) for c in word], np.uint32))
        key = U(0)
        with np.errstate(over="ignore"):
            for x in h:
                key = key * _STEP + x
        return int(key)

    def _beside(self, pairs: dict, a: int, b: int, limit: int) -> bool:
        """Whether no merge of rank below `limit`, or earlier than those within a and b, joins over the border of a and b."""
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit = a
                a = int(self.right[a])
                if a == limit:
                    limit = b + 1
                    b = int(self.left[b])
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = int(self.left[b])
                if b + 1 == limit:
                    limit = a
                    a = int(self.right[a])
                    if a == limit:
                        return True

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_beside for arrays, without a first limit."""
        out = np.ones(len(a), bool)
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.int64(1) << 40)
        who = np.arange(len(a))
        while len(who):
            joined = self.pairs.get((a.view(U) << U(32)) | b.view(U))
            refused = (joined >= 0) & (joined < limit)
            out[who[refused]] = False
            first = a > b
            a2, b2 = self.right[a].astype(np.int64), self.left[b].astype(np.int64)
            stuck_a, stuck_b = a2 == a, b2 == b
            # undo the later merge; where that token is a single character, the other's
            use_a = np.where(first, ~stuck_a, stuck_b & ~stuck_a)
            use_b = np.where(first, stuck_a & ~stuck_b, ~stuck_b)
            go = ~refused & (use_a | use_b)
            limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, a2, a), np.where(use_b, b2, b)
            who, a, b, limit = who[go], a[go], b[go], limit[go]
        return out

    def counts(self, words: list[str]) -> list[np.ndarray]:
        """For each word, the number of tokens of each of its prefixes, from one character to all."""
        size = np.array([len(w) for w in words])
        out: list = [self._long(w) if len(w) > LONG else None for w in words]
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= LONG]
        for a in range(0, len(order), TOGETHER):
            part = order[a : a + TOGETHER].tolist()
            for i, (count, _) in zip(part, self._run([words[i] for i in part]), strict=True):
                out[i] = count
        return out

    def _long(self, word: str) -> np.ndarray:
        """The counts of one long word."""
        cuts = list(range(0, len(word), STRETCH))
        early = max(EARLY, 2 * self.longest)
        counts, lasts = np.empty(len(word), np.int32), np.empty(len(word), np.int64)

        def run(pairs: list[tuple[int, int]]) -> None:
            for (cut, start), x in zip(pairs, self._run([word[s : c + STRETCH] for c, s in pairs]), strict=True):
                ready[cut].append((start, *x))

        for g in range(0, len(cuts), ABREAST):
            group = cuts[g : g + ABREAST]
            ready: dict[int, list] = {a: [] for a in group}
            run([(a, max(0, a - early)) for a in group])
            phased = False
            for j, a in enumerate(group):
                off = self._shift(ready[a], a, counts, lasts)
                if off is None and not phased:
                    # periodic text goes on as it began: starts of every phase, for all stretches that are left
                    phased = True
                    starts = [(b, max(0, b - early - p)) for b in group[j:] for p in range(1, self.longest)]
                    for i in range(0, len(starts), 4 * ABREAST):
                        run(starts[i : i + 4 * ABREAST])
                    off = self._shift(ready[a], a, counts, lasts)
                if off is None:  # from what is known of the characters before
                    b = a - self.longest
                    count, last = self._run([word[b : a + STRETCH]], (counts[b:a], lasts[b:a]))[0]
                    off = (count[self.longest :], last[self.longest :])
                counts[a : a + STRETCH], lasts[a : a + STRETCH] = off
                ready[a] = []
        return counts

    def _shift(self, runs: list, a: int, counts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Counts and last tokens from `a` on, of the first run that agrees with what is known before `a`."""
        for start, count, last in runs:
            if not start:
                return count[a:], last[a:]
            there = slice(a - self.longest - start, a - start)
            shift = count[there] - counts[a - self.longest : a]
            if (last[there] == lasts[a - self.longest : a]).all() and (shift == shift[0]).all():
                return count[a - start :] - shift[0], last[a - start :]
        return None

    def _run(self, words: list[str], known: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each word, the number of tokens and the last token of each of its prefixes; `known` are those of the first prefixes of a single one."""
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size) - size
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        n = len(points)
        h = _chars_hash(points)
        place = np.arange(n) - np.repeat(begin, size)  # of each character in its word
        one = self.chars.get(points.astype(U))
        # every piece that ends at a character: (end, length, rank)
        ends, lengths, ranks_ = [np.flatnonzero(one >= 0)], [np.ones(int((one >= 0).sum()), np.int64)], [one[one >= 0]]
        key = np.zeros(n, U)
        for length in range(1, min(self.longest, int(size.max(initial=0))) + 1):
            # key[i]: of the `length` characters up to i
            key[length - 1 :] = h[: n - length + 1] * U(pow(int(_STEP), length - 1, 2**64)) + key[length - 1 :] if length > 1 else h
            if length == 1:
                continue
            at = np.flatnonzero(place >= length - 1)
            found = self.known.get(key[at])
            hit = found >= 0
            ends.append(at[hit])
            lengths.append(np.full(int(hit.sum()), length))
            ranks_.append(found[hit])
        end, length, rank = np.concatenate(ends), np.concatenate(lengths), np.concatenate(ranks_)
        by = np.argsort(place[end], kind="stable")
        end, length, rank = end[by], length[by], rank[by]
        cut = np.searchsorted(place[end], np.arange(int(size.max(initial=0)) + 1))
        count = np.zeros(n, np.int32)
        last = np.full(n, -1, np.int64)  # -1: bytes stand there, which join nothing
        bytes_ = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        rest = np.argsort(place, kind="stable")
        row = np.searchsorted(place[rest], np.arange(int(size.max(initial=0)) + 1))
        for i in range(len(row) - 1):
            if known is not None and i < len(known[0]):
                count[i], last[i] = known[0][i], known[1][i]
                continue
            here = rest[row[i] : row[i + 1]]
            lone = here[one[here] < 0]
            count[lone] = bytes_[lone] + (count[lone - 1] if i else 0)
            e, k, r = end[cut[i] : cut[i + 1]], length[cut[i] : cut[i + 1]], rank[cut[i] : cut[i + 1]]
            if not len(e):
                continue
            before = e - k
            whole = k == i + 1
            prior = np.where(whole, -1, last[before])
            ok = prior < 0
            test = np.flatnonzero(~ok)
            ok[test] = self.beside(prior[test], r[test])
            e, before, r, whole = e[ok], before[ok], r[ok], whole[ok]
            last[e] = r
            count[e] = 1 + np.where(whole, 0, count[before])
        return [(count[a : a + s], last[a : a + s]) for a, s in zip(begin.tolist(), size.tolist(), strict=True)]


@cache
def pieces(path: str) -> Pieces:
    """Read once per worker."""
    return Pieces(path)


class Counter:
    """Token counts of blocks of texts, keeping the prefix counts of up to KEPT distinct words."""

    def __init__(self, model: Pieces):
        self.model = model
        self.kept = Known(KEPT)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' slots in `kept`, the index of each text's first word, and which words get the blank that precedes every text."""
        if (data == 0xE2).any() and chr(_BLANK).encode() in data.tobytes():
            texts = [data[a:b].tobytes().replace(chr(_BLANK).encode(), b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        n = len(data)
        blank = data == 0x20
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        edge = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        start[edge] = True
        starts = np.flatnonzero(start)
        first = np.zeros(len(starts), bool)
        first[np.searchsorted(starts, edge)] = True
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), first
        ends = np.append(starts[1:], n)
        hashes = word_hashes(data, starts, ends) ^ (first.astype(U) * U(0xD1B54A32D192ED03))
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()

        def make(new: np.ndarray) -> list[np.ndarray]:
            at = index[new]
            words = [(" " if f else "") + raw[a:b].decode() for a, b, f in zip(starts[at].tolist(), ends[at].tolist(), first[at].tolist(), strict=True)]
            return self.model.counts([w.replace(" ", chr(_BLANK)) for w in words])

        return self.kept.slots(distinct, make)[inverse], np.searchsorted(starts, offsets), first

    def totals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        slots, at, _ = self.block(data, offsets)
        last = self.kept.flat[self.kept.start[slots] + self.kept.size[slots] - 1]
        return np.diff(np.concatenate([[0], np.cumsum(last, dtype=np.int64)])[at])

    def prefixes(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each text the number of tokens of each prefix, from one character to all."""
        slots, at, first = self.block(data, offsets)
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            flat, size = self.kept.joined(slots[a:b])
            ends = np.cumsum(size)
            whole = flat[ends - 1].astype(np.int64)
            counts = flat + np.repeat(np.cumsum(whole) - whole, size)
            out.append(counts[1:] if b > a else counts)  # without the blank that precedes the text
        return out


def _counting(path: str, carry: list[str]):
    def run(batches):
        counter = Counter(pieces(path))
        for batch in batches:
            totals = [counter.totals(data, offsets) for _, _, data, offsets in blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(np.concatenate(totals) if totals else np.zeros(0, np.int64), pa.int64())], [*carry, "y"])

    return run


def _listing(path: str, carry: list[str]):
    def run(batches):
        counter = Counter(pieces(path))
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column("text")):
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array([x.tolist() for x in counter.prefixes(data, offsets)], pa.list_(pa.int64()))], [*carry, "y"])

    return run


def _apply(df: DataFrame, text_col: str, make, into: str, kind: str, carry: list[str] | None) -> DataFrame:
    keep = [c for c in (df.columns if carry is None else carry) if c != into]
    names = [f"c{i}" for i in range(len(keep))]  # apart from any name of the input
    part = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([*(f"{n} {part.schema[n].dataType.simpleString()}" for n in names), f"y {kind}"])
    out = part.mapInArrow(make(names), schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), F.col("y").alias(into))


def count_tokens(df: DataFrame, path: str, text_col: str = "text", into: str = "n_tokens", carry: list[str] | None = None) -> DataFrame:
    """The rows (columns in `carry`, all by default) with `into`, the number of tokens of the whole text under the model at `path`.

    Null and empty texts have no tokens. A column already named `into` is replaced.
    """
    return _apply(df, text_col, lambda names: _counting(path, names), into, "bigint", carry)


def prefix_counts(df: DataFrame, path: str, text_col: str = "text", into: str = "prefix_tokens", carry: list[str] | None = None) -> DataFrame:
    """The rows with `into`, an array of the number of tokens of each prefix of the text, from one character to all.

    It answers truncation and budget questions without encoding again (`longest_prefix`).
    """
    return _apply(df, text_col, lambda names: _listing(path, names), into, "array<bigint>", carry)


def longest_prefix(counts: str, budget: int):
    """Characters of the longest prefix of at most `budget` tokens; counts may fall from one prefix to the next."""
    last = F.array_max(F.transform(F.col(counts), lambda x, i: F.when(x <= budget, i + 1).otherwise(0)))
    return F.coalesce(last, F.lit(0))
