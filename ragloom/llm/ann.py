"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

The index is fitted on a bounded sample of the rows: centroids by k-means and codebooks of the residuals' parts. Every
row is indexed, from the sample's mean and in its scale, with the error that its codes leave. A sample of the
queries themselves tells the number of lists to probe, such that their neighbours in the sample of rows are found, and
how much of a row's error an inner product may have. A query goes to the lists that may hold the largest inner
products with it, by their centroids and farthest rows. Lists are put together to shelves of bounded rows, long lists
over several; a query is sent once to each shelf that holds one of its lists. There tables of asymmetric distances rank
all rows of its lists; the first are ranked again by their exact inner product, and so is every other row that may,
within its error, be among the best. The nearest of all shelves are the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.scratch import stored
from ragloom.llm.textwords import trim

#: Rows of the sample that the index is fitted on, and queries that measure the recall of probing and the error of codes.
SAMPLE_ROWS, SAMPLE_QUERIES = 16_384, 512
#: Lists at most and at least, dimensions of a part of the residual, and codes of a part.
MOST_LISTS, LEAST_LISTS, PART, CODES = 4096, 8, 4, 256
#: Recall that the probed lists must give within the sample, and share of the neighbours there whose error the margin covers.
PROBE_RECALL, MARGIN = 0.96, 0.99
#: Rows of a shelf, queries that meet them in one task, and rows of a shelf that are ranked exactly, as a multiple of k.
SHELF_ROWS, SHELF_QUERIES, AGAIN = 16_384, 4_096, 16
#: Products of a query with rows ranked exactly that are made at once.
AT_ONCE = 4_096


@dataclass
class Index:
    size: int  # dimensions
    middle: np.ndarray  # the sample's mean and scale; all below is relative to them
    scale: float
    centroids: np.ndarray
    books: np.ndarray  # (parts, codes, PART); the last part is padded with zeros
    probes: int = 0
    margin: float = 1.0  # share of a row's error, times the query's length, that its inner product may be off

    def parts(self, x: np.ndarray) -> np.ndarray:
        pad = np.zeros((len(x), len(self.books) * PART))
        pad[:, : self.size] = x
        return pad.reshape(len(x), len(self.books), PART)

    def placed(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) / self.scale

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The list and the codes of each row, what these leave of it (a length), and its distance from the list's centroid."""
        x = self.placed(x)
        at = _nearest(x, self.centroids)
        rest = self.parts(x - self.centroids[at])
        codes = np.stack([_nearest(rest[:, m], b) for m, b in enumerate(self.books)], 1).astype(np.uint8)
        left = rest - self.books[np.arange(len(self.books)), codes]
        return at, codes, np.sqrt((left * left).sum((1, 2))), np.sqrt((rest * rest).sum((1, 2)))

    def order(self, q: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The lists, those first that may hold the largest inner products with each query of unit length; `reach`: distance of a list's farthest row."""
        return np.argsort(-(q @ self.centroids.T + min(1.0, 2 / self.size**0.5) * reach), 1, kind="stable")

    def probed(self, q: np.ndarray, sizes: np.ndarray, reach: np.ndarray, need: int) -> np.ndarray:
        """Which lists each query goes to: the first ones, as many as are probed and further until they hold `need` rows."""
        order = self.order(q, reach)
        before = np.cumsum(sizes[order], 1) - sizes[order]
        take = (np.arange(len(sizes)) < self.probes) | (before < need)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, take, 1)
        return out

    def measure(self, sample: np.ndarray, queries: np.ndarray, reach: np.ndarray, k: int) -> None:
        """Sets probes and margin such that the queries' nearest rows in the sample are found."""
        at, codes, error, _ = self.assign(sample)
        held = self.placed(sample)
        rough = self.centroids[at] + self.books[np.arange(len(self.books)), codes].reshape(len(sample), -1)[:, : self.size]
        queries = _unit(queries)
        near = queries @ held.T
        nearest = np.argpartition(-near, min(k, near.shape[1] - 1), 1)[:, : k + 1]
        place = np.argsort(self.order(queries, reach), 1)
        needed = np.sort(np.take_along_axis(place, at[nearest], 1).ravel())
        self.probes = int(min(len(self.centroids), needed[min(len(needed) - 1, int(np.ceil(PROBE_RECALL * len(needed))))] + 1))
        off = np.take_along_axis(near, nearest, 1) - np.einsum("qd,qkd->qk", queries, rough[nearest])
        self.margin = float(np.clip(np.quantile(off / np.maximum(error[nearest], 1e-12), MARGIN), 0, 1))


def _unit(q: np.ndarray) -> np.ndarray:
    q = q / np.abs(q).max(1)[:, None]
    return q / np.sqrt((q * q).sum(1))[:, None]


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return (x @ to.T - 0.5 * (to * to).sum(1)).argmax(1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    draw = np.random.Generator(np.random.PCG64(3))
    at = x[np.sort(draw.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        near = _nearest(x, at)
        count = np.bincount(near, minlength=len(at))
        sums = np.stack([np.bincount(near, x[:, j], len(at)) for j in range(x.shape[1])], 1)
        at[count > 0] = sums[count > 0] / count[count > 0, None]
    return at


def fit(sample: np.ndarray, rows: int) -> Index:
    """Centroids and codebooks of an index for `rows` rows, from a sample of them."""
    lists = int(min(MOST_LISTS, max(LEAST_LISTS, np.sqrt(rows) / 4), max(1, len(sample))))
    size = sample.shape[1]
    middle = (sample / len(sample)).sum(0)
    scale = float(np.abs(sample - middle).max()) or 1.0
    scale *= float(np.sqrt((((sample - middle) / scale) ** 2).sum(1).mean())) or 1.0
    index = Index(size, middle, scale, np.zeros((1, size)), np.zeros((-(-size // PART), 1, PART)))
    x = index.placed(sample)
    index.centroids = _kmeans(x, lists)
    rest = index.parts(x - index.centroids[_nearest(x, index.centroids)])
    index.books = np.stack([_padded(_kmeans(rest[:, m], min(CODES, len(sample)), 6)) for m in range(rest.shape[1])])
    return index


def _padded(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[:1], CODES - len(book), 0)])


def _assigning(index: Index):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float64).reshape(len(batch), index.size)
            at, codes, error, far = index.assign(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(far)], ["id", "v", "list", "codes", "error", "far"])

    return run


def _packing(size: int):
    """Vectors of the right size, finite and not zero, as bytes of doubles."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column("id"), batch.column("v"), strict=True):
                if not v.is_valid or not i.is_valid or len(v) != size or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all() and x.any():
                    ids.append(i.as_py())
                    out.append(x.astype(np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])

    return run


def _probing(index: Index, shelves: list[list[int]], sizes: np.ndarray, reach: np.ndarray, need: int):
    """(q, v, shelf, lists): each query once for each shelf of its lists. shelves[list] are those that hold rows of the list."""
    held = np.zeros((max((max(x) for x in shelves if x), default=-1) + 1, len(shelves)), bool)
    for at, on in enumerate(shelves):
        held[on, at] = True

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float64).reshape(len(batch), index.size)
            wanted = index.probed(_unit(x), sizes, reach, need)
            row, shelf = np.nonzero(wanted.astype(np.float32) @ held.T.astype(np.float32))
            lists = [np.flatnonzero(wanted[r] & held[s]).astype(np.int32) for r, s in zip(row, shelf, strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take), pa.array(shelf.astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))], ["q", "v", "shelf", "lists"])

    return run


def _products(x: np.ndarray, pick: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the picked rows with q, some rows at a time."""
    return np.concatenate([(x[pick[a : a + AT_ONCE]] * q).sum(1) for a in range(0, max(1, len(pick)), AT_ONCE)])


def _searching(index: Index, k: int):
    """The k rows of a shelf nearest to each of its queries."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "near": []}
        kind = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("id")  # so that stable sorts put the smaller id first
            ids = rows.column("id").to_numpy()
            x = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float64).reshape(len(ids), index.size)
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            error = rows.column("error").to_numpy().astype(np.float32) * np.float32(index.margin)
            lists, of = np.unique(rows.column("list").to_numpy(), return_inverse=True)
            base = index.centroids[lists]
            q_ids, asked = queries.column("q").to_numpy(), queries.column("lists").to_pylist()
            q = np.frombuffer(b"".join(queries.column("v").to_pylist()), np.float64).reshape(len(q_ids), index.size)
            books = index.books.astype(np.float32)
            first = min(len(ids), AGAIN * k + 1)
            step = max(1, (1 << 21) // len(ids))
            for a in range(0, len(q), step):
                part = q[a : a + step]
                unit = _unit(part)
                table = np.einsum("qmp,mcp->mqc", index.parts(unit).astype(np.float32), books)
                probed = np.stack([np.isin(lists, x) for x in asked[a : a + step]])
                near = np.where(probed, (unit @ base.T).astype(np.float32), np.float32(-np.inf))[:, of]
                for m in range(codes.shape[1]):
                    near += table[m].take(codes[:, m], 1)
                for j in range(len(part)):
                    near[j, ids == q_ids[a + j]] = -np.inf
                    if first < len(ids):  # all rows above the value that the last of the first has, and the earliest of those equal to it
                        edge = np.partition(near[j], len(ids) - first)[len(ids) - first]
                        above = np.flatnonzero(near[j] > edge)
                        pick = np.sort(np.concatenate([above, np.flatnonzero(near[j] == edge)[: first - len(above)]]))
                    else:
                        pick = np.arange(len(ids))
                    pick = pick[near[j, pick] > -np.inf]
                    exact = _products(x, pick, part[j])
                    if first < len(ids) and len(pick) >= k:  # further rows that may, within their error, be as near as the last of the best
                        last = pick[np.argsort(-exact, kind="stable")[k - 1]]
                        more = near[j] + error >= np.float32(unit[j] @ index.placed(x[last])) - np.float32(1e-6)
                        more[pick] = False
                        if len(more := np.flatnonzero(more)):
                            both = np.concatenate([pick, more])
                            order = np.argsort(both)
                            pick, exact = both[order], np.concatenate([exact, _products(x, more, part[j])])[order]
                    best = np.argsort(-exact, kind="stable")[:k]
                    out["q"].append(int(q_ids[a + j]))
                    out["near"].append([{"s": s, "id": i} for s, i in zip((-exact[best]).tolist(), ids[pick[best]].tolist(), strict=True)])
            trim()
        return pa.table({"q": pa.array(out["q"], pa.int64()), "near": pa.array(out["near"], kind)})

    return run


def _shelved(sizes: dict[int, int], lists: int) -> list[list[int]]:
    """The shelves of each list: small lists together, as long as a shelf has room; a long list over several of its own."""
    shelves: list[list[int]] = [[] for _ in range(lists)]
    at, room = -1, 0
    for j in sorted(sizes):
        n = sizes[j]
        if n > SHELF_ROWS:
            parts = -(-n // SHELF_ROWS)
            shelves[j] = list(range(at + 1, at + 1 + parts))
            at, room = at + parts, 0
            continue
        if n > room:
            at, room = at + 1, SHELF_ROWS
        shelves[j] = [at]
        room -= n
    return shelves


def _sample(rows: DataFrame, many: int, most: int = SAMPLE_ROWS) -> list[bytes]:
    """About `most` distinct rows' vectors, those of least hash, never more. Rows above a bound on the hash stay in their tasks."""
    room = 1 << 40
    key = F.pmod(F.xxhash64("id", "v"), F.lit(room))
    below = min(room, int(room * (most + 4 * most**0.5) / max(1, many)))
    found = rows.where(key < below).select(key.alias("h"), "id", "v").distinct().collect()
    return [bytes(r["v"]) for r in sorted(found, key=lambda r: (r["h"], r["id"]))][:most]


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k nearest rows of `vectors` by inner product, its own id apart.

    Scores are exact inner products in double precision of the original vectors; equal scores go by the smaller id.
    Rows and queries take no part when their id or vector is null, the vector is zero, holds a null or a component
    that is not finite, or has another length than the vectors of the sample most often have. Empty tables give no
    rows. Repeated ids count as rows of their own, except that none is a neighbour of its id.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    queries = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    out_schema = "query_id long, rank int, vec_id long, score double"
    length = vectors.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None or not length["n"]:
        return spark.createDataFrame([], out_schema)
    rows = vectors.mapInArrow(_packing(length["n"]), "id long, v binary")
    many = rows.count()
    sample = _sample(rows, many)
    if not sample:
        return spark.createDataFrame([], out_schema)
    asked = queries.mapInArrow(_packing(length["n"]), "id long, v binary")
    tried = _sample(asked, asked.count(), SAMPLE_QUERIES)
    if not tried:
        return spark.createDataFrame([], out_schema)
    sample, tried = (np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1) for x in (sample, tried))
    index = fit(sample, many)

    filed = stored(rows.mapInArrow(_assigning(index), "id long, v binary, list int, codes binary, error double, far double"), "ann-filed")
    lists = len(index.centroids)  # bounded, and so is what comes to the driver
    counts, reach = {}, np.zeros(lists)
    for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        counts[r["list"]], reach[r["list"]] = r["n"], r["far"]
    index.measure(sample, tried, reach, k)
    shelves, sizes = _shelved(counts, lists), np.array([counts.get(j, 0) for j in range(lists)], np.int64)
    copies = filed.groupBy("id").count().agg(F.max("count")).first()[0]  # of its own id's rows a query takes none
    plan = F.broadcast(spark.createDataFrame(list(enumerate(shelves)), "list int, on array<int>"))
    probes = asked.mapInArrow(_probing(index, shelves, sizes, reach, k + copies), "q long, v binary, shelf int, lists array<int>")
    probes = stored(probes, "ann-probes")
    many = F.broadcast(spark.createDataFrame([(r["shelf"], -(-r["count"] // SHELF_QUERIES)) for r in probes.groupBy("shelf").count().collect()], "shelf int, nq int"))
    own = F.get("on", F.pmod(F.xxhash64("id"), F.size("on")).cast("int"))
    left = filed.join(plan, "list").select("id", "v", "codes", "error", "list", own.alias("shelf")).join(many, "shelf")
    left = left.select("id", "v", "codes", "error", "list", "shelf", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"))
    right = probes.join(many, "shelf").select("q", "v", "lists", "shelf", F.pmod(F.xxhash64("q"), F.col("nq")).cast("int").alias("bq"))
    key = ["shelf", "bq"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searching(index, k), "q long, near array<struct<s:double,id:long>>")
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select(F.col("q").alias("query_id"), F.posexplode("near").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
