"""Exact top-k search by inner product, fusion of ids, context, and frequency of ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import vectors as V
from ragloom.operators.lasting import lasting



def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, metric: Callable[[Column, Column], Column] = V.dot, by: tuple[str, ...] = (), skip_self: bool = False) -> DataFrame:
    """(query, *by, id, score, rank): the k vectors of highest score for each query (and each value of `by`), equal scores by id.

    `queries` is (query, qvec), `vectors` (id, vec, *by). Scores are rounded to 6 places before ranking. The stated
    queries are held against all vectors; ranks are limited before the shuffle.
    """
    few = queries.count() <= FEW  # beyond that Spark pairs partitions; top_k_blocks is for many queries
    pairs = vectors.join(F.broadcast(queries), how="cross") if few else queries.crossJoin(vectors)
    if skip_self:
        pairs = pairs.where(F.col("query") != F.col("id"))
    scored = pairs.select("query", *by, "id", F.round(metric(F.col("qvec"), F.col("vec")), 6).alias("score"))
    at = Window.partitionBy("query", *by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


#: Queries that `top_k` broadcasts at most.
FEW = 1024
#: Vectors that a block of `top_k_blocks` holds, about; and the distance in score that rounding to 6 places can bridge.
BLOCK, NEAR = 2048, 2e-6
#: Bytes of queries that are sent to all tasks at once, at most, and of a part of them, at least; kinds for which a task remembers the best scores.
QUERY_BYTES, LEAST_PART, KINDS = 8 << 20, 1 << 12, 256
#: Scores that a task holds at once, about, and pairs that it keeps before it looks which of them still are among the best.
SCORES, PAIRS = 1 << 22, 1 << 20


def _kept(query: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, kinds: list[tuple], k: int, skip_self: bool, least: dict[tuple, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vector's place, score) of every pair that can be among the k best of its query and kind.

    `least` holds, by kind, the k best scores that each query has met; it is used as a bound and brought up to date.
    """
    score = q @ v.T
    if skip_self:
        own = np.flatnonzero(np.isin(ids, query)) if ids.dtype != object else np.arange(len(ids))
        score[:, own] = np.where(query[:, None] == ids[None, own], -np.inf, score[:, own])
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(kinds):
        groups.setdefault(key, []).append(i)
    left, right = [], []
    for key, own in groups.items():
        part = score if len(own) == len(ids) else score[:, own]
        known = least.get(key)
        if known is None:
            best = part if len(own) <= k else -np.partition(-part, k - 1, axis=1)[:, :k]
            if len(least) < KINDS:
                best = np.concatenate([np.full((len(q), k), -np.inf), best], 1)
                best = least[key] = -np.partition(-best, k - 1, axis=1)[:, :k]
            bound = best.min(1, keepdims=True) if best.shape[1] >= k else -np.inf
            a, b = np.nonzero((part >= bound - NEAR) & (part > -np.inf))
        else:  # only what reaches the scores known is looked at again
            a, b = np.nonzero(part >= np.maximum(known.min(1, keepdims=True) - NEAR, -np.finfo(float).max))
            many, value = np.bincount(a, minlength=len(q)), part[a, b]
            rows = np.flatnonzero(many)
            met = np.full((len(rows), k + many.max(initial=0)), -np.inf)
            met[:, :k] = known[rows]
            met[np.searchsorted(rows, a), k + np.arange(len(a)) - (np.cumsum(many) - many)[a]] = value
            known[rows] = -np.partition(-met, k - 1, axis=1)[:, :k]
            keep = value >= known.min(1)[a] - NEAR
            a, b = a[keep], b[keep]
        left.append(a)
        right.append(np.array(own)[b])
    a, b = np.concatenate(left), np.concatenate(right)
    exact = np.zeros(len(a))
    for d in range(q.shape[1]):  # in the order in which a row's aggregate adds
        exact += q[a, d] * v[b, d]
    # of exactly equal scores the k of least id suffice
    kind = np.zeros(len(ids), np.int64)
    for j, own in enumerate(groups.values()):
        kind[own] = j
    order = np.lexsort((ids[b], -exact, kind[b], a))
    a, b, exact = a[order], b[order], exact[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (kind[b[1:]] != kind[b[:-1]]) | (exact[1:] != exact[:-1])
    at = np.arange(len(a))
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
    return a[keep], b[keep], exact[keep]


def _numbers(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _scanning(queries: pa.Table, k: int, by: tuple[str, ...], skip_self: bool):
    """Of all queries against a task's vectors, block by block, the pairs that are among the k best of them all, or so near that rounding may put them there."""
    names = ["query", *by, "id", "score"]

    def run(batches):
        asked = queries.column("query").combine_chunks()
        query, q, least = asked.to_numpy(zero_copy_only=False), _numbers(queries.column("qvec").combine_chunks()), {}
        step = max(64, min(BLOCK, SCORES // len(q)))
        held: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []
        places: dict[tuple, int] = {}

        def pruned():
            bound = np.array([least[key].min(1) for key in places])
            for kind, a, rows in held:
                score = rows.column("score").to_numpy()
                keep = np.flatnonzero((kind < 0) | (score >= bound[kind, a] - NEAR)) if len(places) else np.arange(len(a))
                yield kind[keep], a[keep], rows.take(pa.array(keep))

        many = 0
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                kinds = list(zip(*(part.column(c).to_pylist() for c in by), strict=True)) if by else [()] * part.num_rows
                a, b, score = _kept(query, q, part.column("id").to_numpy(zero_copy_only=False), _numbers(part.column("vec")), kinds, k, skip_self, least)
                if not len(a):
                    continue
                kind = np.array([places.setdefault(key, len(places)) if key in least else -1 for key in kinds])[b]
                held.append((kind, a, pa.RecordBatch.from_arrays([asked.take(pa.array(a)), *(part.column(c).take(pa.array(b)) for c in by), part.column("id").take(pa.array(b)), pa.array(score)], names)))
                many += len(a)
                if many > PAIRS:
                    held = list(pruned())
                    many = sum(len(x[1]) for x in held)
                    if many > PAIRS // 2:
                        yield from (x[2] for x in held)
                        held, many = [], 0
        yield from (x[2] for x in pruned())

    return run


def top_k_blocks(queries: DataFrame, vectors: DataFrame, k: int = 5, by: tuple[str, ...] = (), skip_self: bool = False, few: int = QUERY_BYTES) -> DataFrame:
    """As `top_k` by inner product, for any number of queries, by matrix products.

    Queries of up to `few` measured bytes go to all tasks, which read the vectors where they are and send on only what
    is among the k best of all they have read. More queries go in parts of that size, with a reading of the vectors for
    each. Scores are added up as `top_k` adds them. Null vectors are left out; all others have one length.
    """
    queries, vectors = queries.where("qvec is not null").select("query", "qvec"), vectors.where("vec is not null").select("id", "vec", *by)
    types = {"query": queries.schema["query"], "id": vectors.schema["id"]} | {c: vectors.schema[c] for c in by}
    schema = ", ".join(f"{c} {types[c].dataType.simpleString()}" for c in ("query", *by, "id")) + ", score double"
    size = queries.agg(F.coalesce(F.sum(F.size("qvec") * 8 + 16), F.lit(0)).alias("b")).first()["b"]
    at = Window.partitionBy("query", *by).orderBy(F.desc("score"), "id")

    def best(part: DataFrame) -> DataFrame:
        held = part.toArrow()
        found = vectors.mapInArrow(_scanning(held, k, by, skip_self), schema) if held.num_rows else vectors.sparkSession.createDataFrame([], schema)
        return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)

    if size <= few:
        return best(queries)
    parts = -(-size // max(few, LEAST_PART))
    queries, vectors = lasting(queries), lasting(vectors)
    found = [lasting(best(queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == p))) for p in range(parts)]
    return reduce(DataFrame.union, found)


def fused(ranked: DataFrame, query: str = "query") -> DataFrame:
    """(query, ids): the distinct ids over all of a query's lists, ascending."""
    return ranked.groupBy(query).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def by_field(ranked: DataFrame, field: str = "field", query: str = "query") -> DataFrame:
    """(query, found): a map from field to its ids in rank order."""
    lists = ranked.groupBy(query, field).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    return lists.groupBy(query).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "ids")))).alias("found"))


def hydrated(hits: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits with the columns of their rows; ids without a row are left out."""
    return hits.join(rows, id_col)


def context(hits: DataFrame, rows: DataFrame, text: str = "content", query: str = "query", most: int = 1000, apart: str = "\n\n") -> DataFrame:
    """(query, context): the non-empty texts of a query's ids in order of id, at most `most` of them, a blank line apart."""
    full = hits.select(query, "id").distinct().join(rows.select("id", text), "id").where(F.coalesce(F.length(text), F.lit(0)) > 0)
    first = F.slice(F.array_sort(F.collect_list(F.struct("id", F.col(text).alias("t")))), 1, most)
    return full.groupBy(query).agg(F.array_join(F.transform(first, lambda x: x["t"]), apart).alias("context"))


def most_common(rows: DataFrame, value: str, k: int, *order: str) -> DataFrame:
    """(value, n): the k most frequent values, equal ones by their first appearance in `order`."""
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def positions_named(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Ids of positional hits from (position, id); unknown positions have a null id."""
    return hits.join(names, "position", "left")


#: Bytes of a shingle; bytes of shingles' hashes that are looked up in one reading of the documents; bytes of a text hashed at once.
SHINGLE, LOOKED_UP, PIECE = 24, 8 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.Generator(np.random.PCG64(12)).integers(1, 2**64, 256, dtype=np.uint64)


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive bytes."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    power, back = np.full(len(data), _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    power[0] = back[0] = 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * np.multiply.accumulate(power), out=total[1:])
    return ((total[size:] - total[:-size]) * np.multiply.accumulate(back)).view(np.int64)


def _aligned(size: int):
    """(passage, size, hash) of the passages' shingles at multiples of their size; a shorter passage is one shingle."""

    def run(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in batch.column(0).to_pylist():
                raw = text.encode()
                n = min(size, len(raw))
                hashes = np.unique(shingle_hashes(raw, n)[::n]).tolist()
                for column, values in zip(out, ([text] * len(hashes), [n] * len(hashes), hashes), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["passage", "size", "hash"])

    return run


def _holding(wanted: dict[int, np.ndarray]):
    """(doc, size, hash) of the wanted shingles that each document holds at any place."""

    def run(batches):
        for batch in batches:
            rows, sizes, found = [], [], []
            for k, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode()
                for size, known in wanted.items():
                    hits = [np.zeros(0, np.int64)]
                    for a in range(0, len(raw), PIECE):
                        here = shingle_hashes(raw[a : a + PIECE + size - 1], size)
                        at = np.searchsorted(known, here)
                        hits.append(here[known[np.minimum(at, len(known) - 1)] == here])
                    new = np.unique(np.concatenate(hits))
                    rows += [k] * len(new)
                    sizes += [size] * len(new)
                    found.append(new)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["doc", "size", "hash"])

    return run


def containment(passages: DataFrame, docs: DataFrame, item: str = "item_id", text: str = "text", doc: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(item, n): in how many documents each passage occurs verbatim; each row of passages counts for itself.

    Documents tell which of the passages' shingles they hold; a passage is looked up by the one of its shingles that
    fewest documents hold, and each pair that meets is compared as a whole. One reading of the documents looks up
    LOOKED_UP bytes of shingles; more passages take several. Null and empty passages occur nowhere.
    """
    texts = passages.select(F.col(text).cast("string").alias("passage")).where("passage <> ''").distinct()
    pieces = lasting(texts.mapInArrow(_aligned(size), "passage string, size int, hash long"))
    parts = -(-pieces.count() * 8 // LOOKED_UP)
    whole, hits = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")), None
    for p in range(parts):
        part = pieces.where(F.pmod(F.xxhash64("passage"), F.lit(parts)) == p)
        wanted: dict[int, list[int]] = {}
        for r in part.select("size", "hash").distinct().collect():  # about LOOKED_UP bytes
            wanted.setdefault(r["size"], []).append(r["hash"])
        sorted_ = {n: np.sort(np.array(h, np.int64)) for n, h in wanted.items()}
        found = lasting(whole.where("text is not null").mapInArrow(_holding(sorted_), f"doc {whole.schema['doc'].dataType.simpleString()}, size int, hash long").distinct())
        many = found.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n"))
        # a passage of which some shingle is held by no document is in none
        rarest = part.join(many, ["size", "hash"], "left").groupBy("passage").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "hash")).alias("r")).where("r.n > 0").select("passage", "r.size", "r.hash")
        met = rarest.join(found, ["size", "hash"]).select("passage", "doc").join(whole, "doc").where(F.contains("text", "passage")).select("passage", "doc").distinct()
        hits = met if hits is None else hits.union(met)
    if hits is None:
        return passages.select(item, F.lit(0).cast("long").alias("n"))
    counts = hits.groupBy("passage").agg(F.count(F.lit(1)).alias("_n"))
    return passages.select(F.col(item), F.col(text).cast("string").alias("_p")).join(counts, F.col("_p") == F.col("passage"), "left").select(item, F.coalesce("_n", F.lit(0)).alias("n"))
