"""Removal of repeated passages by compaction of a de Bruijn graph over word k-mers.

An edge of the graph is a k-mer of `window` words, from the node of its first k - 1 words to the node of its
last; an edge that two source coordinates share is repeated. The steps:

1. Copies of a whole text are one source with a count. Sources are 64-bit hashes; where a second hash shows
   that two texts share one, these texts get another.
2. Every window has an anchor: the least hash among the shorter k-mers within it. Equal windows have
   equal anchors, so windows whose anchor is found at one coordinate only are no repeated edges. Anchors
   are a tenth of the words and are dealt over buckets as packed arrays.
3. The remaining windows are dealt by the hashes of their two nodes, which name the edge, with their source
   coordinates. The edge's first coordinate stands for it. Windows repeated within one batch of a task send
   one row, and the others refer to that one, so a passage that a third of all texts share stays small.
4. Degrees of the nodes of all distinct repeated edges come from one aggregation. Where one edge comes in and
   one goes out, the two belong to one path: edges that also follow each other in their source compact to
   pieces, and pieces to paths, by joins of ever longer reach (`_paths`).
5. A source's repeated coordinates that follow each other as the coordinates they refer to do are a span. Where
   these lie on paths, it goes along them: a source's parts that follow each other on one path are one stretch,
   a reference to that path, its first edge and its length (`_along`). The words at both coordinates of a span
   must have one digest; should one differ, two edges shared a hash, and all is done again with other hashes.
6. The texts join their spans and lose the covered words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm import spread
from ragloom.llm.scratch import drop, sized, stored
from ragloom.llm.textwords import U, blocks, bounds, gram_hashes, long_gram_hashes, mixed, sliding_min, trim, word_hashes

#: Words of an anchor k-mer, at most; shorter windows use half their length.
ANCHOR = 16
#: Items that a task collects before it packs them.
FLUSH = 1 << 18
#: Edges of a block of coordinates by which spans meet pieces of paths.
BLOCK = 256
#: Bases of the nodes' hashes; a further one is used when words at coordinates of one edge are found to differ.
BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _blocks(batch: pa.RecordBatch, window: int, seen: set[int]) -> Iterator[tuple]:
    """(first row, word hashes, first word of each text, words of each text) of blocks with a window; texts seen before count as without words."""
    keys = batch.column("u").to_numpy()
    for row, end, data, offsets in blocks(batch.column("text")):
        starts, ends, first = bounds(data, offsets)
        size = np.diff(first)
        for d in range(end - row):
            if size[d] >= window:
                if (key := int(keys[row + d])) in seen:
                    size[d] = 0
                seen.add(key)
        if (size >= window).any():
            yield row, keys[row:end], word_hashes(data, starts, ends), first, size


def _windows(first: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of all windows that lie within a text of the block, and their texts."""
    n = np.maximum(size - window + 1, 0)
    text = np.repeat(np.arange(len(size)), n)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][text]
    return start, text


def _anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each anchor-sized k-mer, and for each window of the block the position of its anchor.

    The anchor is the leftmost k-mer of least hash, so equal windows agree on it.
    """
    k = min(ANCHOR, (window + 1) // 2)
    grams = gram_hashes(words, k)
    span = window - k + 1
    least = sliding_min(grams, span)
    at = np.zeros(len(least), np.int64)
    for j in range(span - 1, -1, -1):
        hit = np.flatnonzero(grams[j : j + len(least)] == least)
        at[hit] = hit + j
    return grams, at


def _runs(positions: np.ndarray) -> bytes:
    """Sorted distinct positions as runs: the gap before each and its length, deflated."""
    cut = np.flatnonzero(np.diff(positions) != 1) + 1
    start = np.concatenate([positions[:1], positions[cut]]).astype(np.int64)
    count = np.diff(np.concatenate([[0], cut, [len(positions)]]))
    gap = start - np.concatenate([[0], (start + count)[:-1]])
    return zlib.compress(np.stack([gap, count]).astype(np.uint32).tobytes(), 1)


def _positions(runs: bytes, length: int) -> np.ndarray:
    """A flag per position from such runs."""
    gap, count = np.frombuffer(zlib.decompress(runs), np.uint32).reshape(2, -1).astype(np.int64)
    end = np.cumsum(gap + count)
    flag = np.zeros(length + 1, np.int32)
    # distinct starts and distinct ends, so plain indexing adds each
    flag[np.minimum(end - count, length)] += 1
    flag[np.minimum(end, length)] -= 1
    return np.cumsum(flag[:length]) > 0


class _Dealer:
    """Sends each item (hashes, owner, position) to its bucket; items equal within the batch are known as repeated and send one row.

    The others are sent as coordinates, with the coordinate of the one that is sent where `refer` is set.
    """

    def __init__(self, buckets: int, hashes: int, refer: bool):
        self.buckets, self.hashes, self.refer = buckets, hashes, refer
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, owner: np.ndarray, position: np.ndarray, *hashes: np.ndarray) -> None:
        self.parts.append((owner, position.astype(np.uint32), *hashes))
        self.held += len(position)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        owner, position, *hashes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(hashes[0], kind="stable") if self.hashes == 1 else np.lexsort((hashes[1], hashes[0]))
        new = np.zeros(len(order), bool)
        new[0] = True
        for h in hashes:
            h = h[order]
            new[1:] |= h[1:] != h[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(order)))
        lead = order[np.repeat(at, size)]  # of each item in order
        known = np.repeat(size > 1, size) & ((lead != order) | (not self.refer))
        refers = _Coordinates(owner[order][known], position[order][known], *((owner[lead[known]], position[lead[known]], 1) if self.refer else ()))
        multi = np.zeros(len(order), np.uint8)
        multi[order[at]] = size > 1
        lead = np.sort(order[at])  # as they came, so that a source's rows stay together
        pack = spread.Packer(self.buckets, [U] * self.hashes + [np.uint32, np.uint8])
        pack.add(((mixed(hashes[0][lead]) >> U(32)) * U(self.buckets)) >> U(32), owner[lead].view(U), *(h[lead] for h in hashes), position[lead], multi[lead])
        yield from _kind(pack, 0)
        yield from _kind(refers.packed(self.buckets), 1)


class _Coordinates:
    """Repeated coordinates and, if given, those they refer to: at level 0 the first of the edge, at level 1 one that was sent in their place."""

    KINDS = [np.uint32, U, np.uint32, np.uint8]

    def __init__(self, owner: np.ndarray, position: np.ndarray, to: np.ndarray | None = None, to_position: np.ndarray | None = None, level: int = 0):
        self.owner = owner.view(U)
        self.payload = [position] if to is None else [position, to.view(U), to_position, np.full(len(position), level, np.uint8)]

    def packed(self, parts: int) -> spread.Packer:
        """By their owner over `parts`."""
        order = np.argsort(self.owner, kind="stable")
        pack = spread.Packer(parts, self.KINDS[: len(self.payload)])
        if len(order):
            owner = self.owner[order]
            pack.add(mixed(owner) % U(parts), owner, *(x[order] for x in self.payload))
        return pack


def _kind(pack: spread.Packer, kind: int) -> Iterator[pa.RecordBatch]:
    for batch in pack.batches():
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), kind, np.int32))], ["bucket", "blob", "kind"])


#: kind 0: items to compare; kind 1: coordinates already known as repeated.
_DEALT = "bucket int, blob binary, kind int"


def _deal_anchors(window: int, buckets: int):
    def run(batches):
        deal = _Dealer(buckets, 1, False)
        seen: set[int] = set()
        for batch in batches:
            for _, keys, words, first, size in _blocks(batch, window, seen):
                grams, at = _anchors(words, window)
                at = np.unique(at[_windows(first, size, window)[0]])
                text = np.searchsorted(first, at, "right") - 1
                deal.add(keys[text], at - first[text], grams[at])
                if deal.held >= FLUSH:
                    yield from deal.batches()
                    seen.clear()
        yield from deal.batches()

    return run


def _nodes(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """The hash of the node at each word: of the window - 1 words from there on."""
    return long_gram_hashes(words, window - 1, base)


def _deal_windows(window: int, buckets: int, base: int):
    """Windows whose anchor is repeated."""

    def run(batches):
        deal = _Dealer(buckets, 2, True)
        seen: set[int] = set()
        for batch in batches:
            found = batch.column("found")
            for row, keys, words, first, size in _blocks(batch, window, seen):
                flag = np.zeros(len(words), bool)
                for d in np.flatnonzero(size >= window):
                    flag[first[d] : first[d + 1]] = _positions(found[row + int(d)].as_py(), int(size[d]))
                _, at = _anchors(words, window)
                start, text = _windows(first, size, window)
                want = flag[at[start]]
                start, text = start[want], text[want]
                nodes = _nodes(words, window, base)
                deal.add(keys[text], start - first[text], nodes[start], nodes[start + 1])
                if deal.held >= FLUSH:
                    yield from deal.batches()
                    seen.clear()
        yield from deal.batches()

    return run


def _same(table: pa.Table, hashes: int) -> tuple:
    """The bucket's compared items in the order of their hashes: owners, positions, hashes, where a run of equal ones begins, its size, and whether it is repeated."""
    owners, index, payload = spread.unpacked(table.column("blob").filter(pc.equal(table.column("kind"), 0)), [U] * hashes + [np.uint32, np.uint8])
    *keys, position, multi = payload
    # rows of one coordinate may come from several tasks that saw a copy of its text
    coordinate = (index.astype(U) << U(32)) | position
    order = np.lexsort((coordinate, *reversed(keys)))
    keys, coordinate, multi = [k[order] for k in keys], coordinate[order], multi[order]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(order)))
    again = (coordinate[at] != coordinate[at + size - 1]) | (np.maximum.reduceat(multi, at) > 0)
    return owners[index[order]], position[order], keys, at, size, again


_PACKED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _passed(table: pa.Table) -> list[pa.RecordBatch]:
    """Coordinates that were known before: packed by source already, over as many parts as there are buckets."""
    return table.filter(pc.equal(table.column("kind"), 1)).select(["bucket", "blob"]).cast(_PACKED).to_batches()


def _repeated_anchors(parts: int):
    """The coordinates of the bucket's anchors that another coordinate also has, and those known before, packed by source."""

    def run(table: pa.Table) -> pa.Table:
        batches = []
        kind = table.column("kind").to_numpy()
        if (kind == 0).any():
            owner, position, _, at, size, again = _same(table, 1)
            again = np.repeat(again, size)
            batches += _Coordinates(owner[again], position[again]).packed(parts).batches()
        batches += _passed(table)
        trim()
        return pa.Table.from_batches(batches, _PACKED)

    return run


def _repeated_edges(parts: int):
    """The bucket's repeated edges (l, r, u, p), u and p their first coordinate, and their coordinates, packed by source."""
    schema = pa.schema([*_PACKED, ("l", pa.int64()), ("r", pa.int64()), ("u", pa.int64()), ("p", pa.int32())])
    names = schema.names

    def rows(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, schema.field(c).type)) for c in names], schema=schema)

    def run(table: pa.Table) -> pa.Table:
        packed, batches = [], []
        kind = table.column("kind").to_numpy()
        if (kind == 0).any():
            owner, position, (left, right), at, size, again = _same(table, 2)
            lead = at[again]
            each = np.repeat(again, size)
            to = np.repeat(lead, size[again])
            packed += _Coordinates(owner[each], position[each], owner[to], position[to], 0).packed(parts).batches()
            edge = {"l": left[lead].view(np.int64), "r": right[lead].view(np.int64), "u": owner[lead].view(np.int64), "p": position[lead].astype(np.int32)}
            batches.append(rows({c: pa.array(x) for c, x in edge.items()}, len(lead)))
        packed += _passed(table)
        batches += [rows({c: b.column(c) for c in ("bucket", "blob")}, len(b)) for b in packed]
        trim()
        return pa.Table.from_batches(batches, schema)

    return run


def _flagged(table: pa.Table) -> pa.Table:
    """(u, found): each source's repeated positions as runs."""
    owners, index, (position,) = spread.unpacked(table.column("blob"), [np.uint32])
    both = np.unique((index.astype(U) << U(32)) | position)
    index, position = (both >> U(32)).astype(np.int64), (both & U(0xFFFFFFFF)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(index)) + 1, [len(index)]])
    runs = [_runs(position[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    trim()
    return pa.table({"u": pa.array(owners[index[cut[:-1]]].view(np.int64)), "found": pa.array(runs, pa.binary())})


def _spans(table: pa.Table) -> pa.Table:
    """(u, p, n, ru, rp, level): stretches of a source's repeated coordinates that refer to a like stretch of another place."""
    owners, index, (position, to, to_position, level) = spread.unpacked(table.column("blob"), _Coordinates.KINDS)
    order = np.lexsort((to_position, to, level, position, index))
    index, position, to, to_position, level = (x[order] for x in (index, position, to, to_position, level))
    # a coordinate may have come more than once; its first reference counts
    new = np.ones(len(index), bool)
    new[1:] = (index[1:] != index[:-1]) | (position[1:] != position[:-1])
    index, position, to, to_position, level = (x[new] for x in (index, position, to, to_position, level))
    begin = np.ones(len(index), bool)
    begin[1:] = (index[1:] != index[:-1]) | (position[1:] != position[:-1] + 1) | (to[1:] != to[:-1]) | (to_position[1:] != to_position[:-1] + 1) | (level[1:] != level[:-1])
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, len(index)))
    columns = {"u": owners[index[at]].view(np.int64), "p": position[at].astype(np.int32), "n": size.astype(np.int32), "ru": to[at].view(np.int64), "rp": to_position[at].astype(np.int32), "level": level[at].astype(np.int32)}
    trim()
    return pa.table({c: pa.array(x) for c, x in columns.items()})


def _stretches(pieces: DataFrame, u: str, p: str, n: str) -> DataFrame:
    """(u, a, b): the stretches of each source that intervals (u, p, n) cover, those that touch joined."""
    line = Window.partitionBy("u").orderBy("a")
    rows = pieces.select(F.col(u).alias("u"), F.col(p).alias("a"), (F.col(p) + F.col(n)).alias("b"))
    reach = F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("a")).cast("int"))
    return rows.withColumn("k", F.sum("new").over(line)).groupBy("u", "k").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("u", "a", "b")


def _paths(edges: DataFrame) -> DataFrame:
    """(u, p, n, path, at) of the pieces of all paths: n edges from coordinate (u, p) on, which are the path's from its edge `at` on.

    Two edges belong to one path where they meet at a node with no other edge in or out. Edges of a path whose
    coordinates follow each other are a piece at once; pieces then find the start of their path by joins that double
    their reach, a number of rounds that grows with the logarithm of the pieces of the longest path. The pieces of a
    path that closes on itself stay paths of their own.
    """
    ends = [F.struct(F.col(v).alias("v"), F.lit(i).alias("i"), F.lit(1 - i).alias("o")) for v, i in (("r", 1), ("l", 0))]
    degrees = edges.select(F.explode(F.array(*ends)).alias("x")).select("x.*").groupBy("v").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    plain = degrees.where("i = 1 and o = 1").select("v")
    marked = edges.join(plain, F.col("l") == F.col("v"), "left").select("u", "p", "l", "r", F.col("v").isNotNull().alias("inner"))
    line = Window.partitionBy("u").orderBy("p")
    follows = F.col("inner") & F.coalesce(F.lag("p").over(line) == F.col("p") - 1, F.lit(False))
    cut = marked.withColumn("k", F.sum((~follows).cast("int")).over(line))
    pieces = cut.groupBy("u", "k").agg(F.min("p").alias("p"), F.count(F.lit(1)).cast("int").alias("n"), F.min_by("l", "p").alias("l"), F.max_by("r", "p").alias("r"), F.min_by("inner", "p").alias("inner"))
    pieces = stored(pieces.select(F.monotonically_increasing_id().alias("k"), "u", "p", "n", "l", "r", "inner"), "passages-pieces")
    before = pieces.select(F.col("k").alias("up"), F.col("r").alias("l"), F.col("n").cast("long").alias("d"))
    jump = stored(pieces.where("inner").select("k", "l").join(before, "l").where("k != up").select("k", "up", "d"), "passages-jumps")
    rounds, left = int(jump.count()).bit_length() + 1, True
    while left and rounds:
        on = jump.select(F.col("k").alias("up"), F.col("up").alias("over"), F.col("d").alias("e"))
        further = jump.join(on, "up", "left").select("k", F.coalesce("over", "up").alias("up"), (F.col("d") + F.coalesce("e", F.lit(0))).alias("d"), F.col("over").isNotNull().alias("more"))
        further = stored(further, "passages-jumps")
        drop(jump)
        left, rounds, jump = not further.where("more").isEmpty(), rounds - 1, further.select("k", "up", "d", "more")
    if "more" in jump.columns:
        jump = jump.where("not more")
    out = pieces.join(jump.select("k", "up", "d"), "k", "left").select("u", "p", "n", F.coalesce("up", "k").alias("path"), F.coalesce("d", F.lit(0)).alias("at"))
    out = stored(out, "passages-paths")
    drop(pieces, jump)
    return out


def _along(spans: DataFrame, paths: DataFrame) -> DataFrame:
    """(u, p, n, path, at): the stretches of sources that follow a path, from their word p and its edge `at` on for n edges.

    The edges that a span refers to lie on pieces of paths, which are met by blocks of coordinates, so that a span meets
    only pieces near it. Parts that follow each other in their source and on one path are one stretch, and its length is
    what it goes along that path.
    """
    blocks_of = lambda p, n: F.explode(F.sequence(F.floor(F.col(p) / BLOCK), F.floor((F.col(p) + F.col(n) - 1) / BLOCK))).alias("block")
    pieces = paths.select(F.col("u").alias("ru"), F.col("p").alias("q"), F.col("n").alias("m"), "path", "at", blocks_of("p", "n"))
    parts = spans.select("u", "p", "n", "ru", "rp", blocks_of("rp", "n")).join(pieces, ["ru", "block"])
    low = F.greatest(F.col("rp"), F.col("q"), F.col("block") * BLOCK)
    high = F.least(F.col("rp") + F.col("n"), F.col("q") + F.col("m"), (F.col("block") + 1) * BLOCK)
    parts = parts.where(low < high).select("u", (F.col("p") + low - F.col("rp")).cast("int").alias("p"), "path", (F.col("at") + low - F.col("q")).cast("long").alias("at"), (high - low).cast("long").alias("n"))
    line = Window.partitionBy("u").orderBy("p")
    on = (F.lag("path").over(line) == F.col("path")) & (F.lag(F.col("at") + F.col("n")).over(line) == F.col("at")) & (F.lag(F.col("p") + F.col("n")).over(line) == F.col("p"))
    cut = parts.withColumn("k", F.sum((~F.coalesce(on, F.lit(False))).cast("int")).over(line))
    out = cut.groupBy("u", "k").agg(F.min("p").alias("p"), F.first("path").alias("path"), F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("end"))
    return out.select("u", "p", (F.col("end") - F.col("at")).cast("int").alias("n"), "path", "at")


def _digests(window: int):
    """(u, p, n, d): for each wanted stretch of n windows from word p on, the digest of its words."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out: dict[str, list] = {"u": [], "p": [], "n": [], "d": []}
            sources, wanted = batch.column("u").to_pylist(), batch.column("wanted")
            for row, end, data, offsets in blocks(batch.column("text")):
                raw = data.tobytes()
                for d in range(end - row):
                    if (u := sources[row + d]) in seen:
                        continue
                    seen.add(u)
                    words = raw[offsets[d] : offsets[d + 1]].split()
                    for x in wanted[row + d].as_py():
                        out["u"].append(u)
                        out["p"].append(x["p"])
                        out["n"].append(x["n"])
                        out["d"].append(hashlib.blake2b(b" ".join(words[x["p"] : x["p"] + x["n"] + window - 1]), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(out["u"], pa.int64()), pa.array(out["p"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["d"], pa.binary())], list(out))

    return run


def _verified(spans: DataFrame, texts: DataFrame, window: int) -> bool:
    """Whether every span's words are the words at the coordinate it refers to."""
    wanted = spans.select("u", "p", "n").union(spans.select("ru", "rp", "n")).distinct()
    wanted = stored(wanted.groupBy("u").agg(F.collect_list(F.struct("p", "n")).alias("wanted")), "passages-wanted")
    # only texts that are wanted take part in the join, which shuffles them where what is wanted is large
    rows = texts.join(sized(wanted.select("u")), "u", "left_semi").join(sized(wanted, F.size("wanted") * 32), "u").select("u", "text", "wanted")
    found = stored(rows.mapInArrow(_digests(window), "u long, p int, n int, d binary").dropDuplicates(["u", "p", "n"]), "passages-digests")
    one, two = found.withColumnRenamed("d", "d1"), found.select(F.col("u").alias("ru"), F.col("p").alias("rp"), "n", F.col("d").alias("d2"))
    away = spans.join(one, ["u", "p", "n"]).join(two, ["ru", "rp", "n"]).where("d1 != d2")
    same = away.isEmpty()
    drop(wanted, found)
    return same


def _cut(window: int, carry: list[str], text_at: str):
    """Texts without the words that repeated windows cover."""

    def run(batches):
        for batch in batches:
            found, copies = batch.column("found"), batch.column("copies").to_pylist()
            n_words, n_removed, kept, spans = [], [], [], []
            for row, end, data, offsets in blocks(batch.column(text_at)):
                starts, ends, first = bounds(data, offsets)
                raw = data.tobytes()
                for d in range(end - row):
                    i, a, n = row + d, int(first[d]), int(first[d + 1] - first[d])
                    gone = np.zeros(n, bool)
                    if n >= window:
                        if (copies[i] or 0) > 1:
                            gone[:] = True
                        elif found[i].is_valid:
                            step = np.zeros(n + window, np.int32)
                            begin, runs = (found[i].values.field(c).to_numpy() for c in ("p", "n"))
                            np.add.at(step, begin, 1)
                            np.add.at(step, begin + runs + window - 1, -1)
                            gone = np.cumsum(step)[:n] > 0
                    n_words.append(n)
                    n_removed.append(int(gone.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
                    words = raw[offsets[d] : offsets[d + 1]].split()
                    for s, e in reversed(edge):
                        del words[s:e]
                    kept.append(b" ".join(words).decode())
                    spans.append([{"start": s, "n": e - s} for s, e in edge])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))],
                [*carry, "n_words", "n_removed", "kept", "spans"],
            )

    return run


_CUT = "n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,n:bigint>>"


def _sources(texts: DataFrame, text: Column) -> tuple[Column, DataFrame]:
    """(expression of a text's source, sources of more than one copy): the 64-bit hash, or another where texts of unlike digests share it."""
    source = F.xxhash64(text)
    for salt in range(1, 9):
        of = texts.select(source.alias("u"), F.xxhash64(F.lit(0), text).alias("m")).groupBy("u").agg(F.count(F.lit(1)).alias("copies"), F.min("m").alias("a"), F.max("m").alias("b"))
        of = stored(of.where("copies > 1"), "passages-copies")
        # texts that share a 64-bit hash: some tens among 50 billion
        shared = [r["u"] for r in of.where("a != b").select("u").limit(10_001).collect()]
        if not shared:
            return source, of.select("u", "copies")
        if len(shared) > 10_000:
            break
        drop(of)
        source = F.when(source.isin(shared), F.xxhash64(F.lit(salt), text)).otherwise(source)
    raise ValueError("too many texts share a 64-bit hash")


def _known(texts: DataFrame, length: int, window: int) -> DataFrame:
    """(u, found): the windows of each source that also start elsewhere, as runs of positions."""
    # about a sixth of the bytes are words, a tenth of these anchors; of the windows, far from all are dealt
    parts = spread.bucket_count(length // 50)
    dealt = texts.select("u", "text").mapInArrow(_deal_anchors(window, parts), _DEALT)
    reduced = dealt.groupBy("bucket").applyInArrow(_repeated_anchors(parts), spread.SCHEMA)
    anchored = stored(reduced.groupBy("bucket").applyInArrow(_flagged, "u long, found binary"), "passages-anchors")
    windows = texts.join(sized(anchored, "found"), "u").select("u", "text", "found")
    parts = spread.bucket_count(length // 20)
    for base in BASES:
        dealt = windows.mapInArrow(_deal_windows(window, parts, base), _DEALT)
        both = stored(dealt.groupBy("bucket").applyInArrow(_repeated_edges(parts), "bucket int, blob binary, l long, r long, u long, p int"), "passages-edges")
        spans = stored(both.where("blob is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_spans, "u long, p int, n int, ru long, rp int, level int"), "passages-spans")
        paths = _paths(both.where("blob is null").select("l", "r", "u", "p"))
        drop(both)
        first = stored(_along(spans.where("level = 0"), paths), "passages-first")
        # those that refer to what was sent in their place hold where that has been placed itself
        sent = spans.where("level = 1")
        placed = _stretches(first.join(sent.select(F.col("ru").alias("u")).distinct(), "u", "left_semi"), "u", "p", "n").toDF("ru", "a", "b")
        within = (F.col("rp") >= F.col("a")) & (F.col("rp") + F.col("n") <= F.col("b"))
        held = stored(first.select("u", "p", "n").union(sent.join(placed, "ru").where(within).select("u", "p", "n")), "passages-held")
        same = _verified(spans.where("u != ru or p != rp").select("u", "p", "n", "ru", "rp"), texts, window)
        drop(spans, paths, first)
        if same:
            drop(anchored)
            runs = _stretches(held, "u", "p", "n").select("u", F.struct(F.col("a").alias("p"), (F.col("b") - F.col("a")).alias("n")).alias("x"))
            return runs.groupBy("u").agg(F.array_sort(F.collect_list("x")).alias("found"))
        drop(held)
    raise ValueError("edges share hashes under every base")


def repeated_passages(docs: DataFrame, text_col: str = "text", window: int = 35, carry: list[str] | None = None) -> DataFrame:
    """Rows of the input with the columns in `carry` (all by default), `n_words`, `n_removed`, `kept` and `spans`.

    `kept` holds the words left, joined by one space; `spans` the removed stretches (start word, number of words). A
    word goes when a window of `window` consecutive words covers it whose word sequence also starts anywhere else, in
    the same text included; windows are judged on the input. Words are runs of other than ASCII white space, unchanged.
    Null and empty texts have no words and keep an empty text; texts shorter than a window keep all words. Repeated
    rows count as other places. Columns of the input named like the new ones are replaced. `window` is 2 at least.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("n_words", "n_removed", "kept", "spans")]
    text = F.col(text_col).cast("string")
    texts = docs.select(text.alias("text")).where("text is not null")
    source, copies = _sources(texts, F.col("text"))
    texts = texts.withColumn("u", source)
    length = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    known = stored(_known(texts, length, window).join(copies, "u", "full_outer"), "passages-known")

    names = [f"c{i}" for i in range(len(carry))]  # apart from any name of the input
    full = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)), text.alias("text"))
    full = full.withColumn("u", F.when(F.col("text").isNotNull(), source)).join(sized(known, F.size("found") * 32), "u", "left")
    schema = ", ".join([*(f"{n} {full.schema[n].dataType.simpleString()}" for n in names), _CUT])
    out = full.select(*names, "text", "found", "copies").mapInArrow(_cut(window, names, "text"), schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), "n_words", "n_removed", "kept", "spans")


def without_passages(docs: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """The input's rows and columns; a text that loses words is replaced by what is left of it, others stay as they are."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    out = repeated_passages(docs.select(*(F.col(c).alias(n) for c, n in names.items())), names[text_col], window)
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(names[text_col]))
    return out.select(*((new if c == text_col else F.col(n)).alias(c) for c, n in names.items()))


#: DuckDB's form of the query op5 (default parameters).
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS k FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM c WHERE k > 1),
x AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
k AS (SELECT x.doc_id, count(g.p) AS gone, coalesce(string_agg(CASE WHEN g.p IS NULL THEN v END, ' ' ORDER BY x.p), '') AS kept
      FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
