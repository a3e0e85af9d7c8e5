"""Ranked lexical search in windows of documents.

One scan of the texts writes postings: documents are numbered as they come in their partition, a window is WINDOW
consecutive numbers, and a row of the index holds one window's documents, their lengths, and the postings of each term
that some item asks for, packed. Sums over these rows give the corpus statistics. Scoring goes through the windows of a
partition in turn: the contribution of every posting is computed once, each item's terms are added into an array with a
number for each document of the window (which stays in the processor's cache), a bitset tells which stretches of the
array were touched, and what beats the least of the item's heap is harvested from those. Heaps live through all windows
of a partition; a window function then ranks what the partitions kept.

Terms are compared by their bytes, not by hashes. Items are a stated query set: they are handled in blocks of bounded
bytes, one scan of the texts a block.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.scratch import drop, stored
from ragloom.llm.terms import runs
from ragloom.llm.textwords import buffers, trim

#: Documents of a window (their scores take 32 KB), of a bit of the bitset, and postings with which a window is closed early.
WINDOW, STRETCH, POSTINGS = 4096, 64, 1 << 20
#: Bytes of items' texts that are searched for together: they, their terms and their heaps are in every task.
ITEM_BYTES = 8 << 20
#: Hits of an item.
BEST = 20

_NULL = -(1 << 63) - 1  # below every negated id
_INDEX = "ids array<bigint>, sizes binary, terms array<int>, found array<int>, docs binary, times binary"


def counted(raw: bytes) -> Counter:
    """Terms of a text and how often they occur."""
    out: Counter = Counter()
    for words in runs(raw):
        out.update(words)
    return out


class _Open:
    """The window that is being filled."""

    def __init__(self, most: int):
        self.most = most
        self.ids: list = []
        self.sizes: list[int] = []
        self.terms: list[int] = []
        self.docs: list[int] = []
        self.times: list[int] = []

    def full(self) -> bool:
        return len(self.ids) >= self.most or len(self.terms) >= POSTINGS

    def row(self) -> pa.RecordBatch:
        terms, docs, times = np.int32(self.terms), np.uint16(self.docs), np.uint32(self.times)
        order = np.argsort(terms, kind="stable")
        distinct, found = np.unique(terms, return_counts=True)
        values = ([self.ids], [np.int64(self.sizes).tobytes()], [distinct], [found.astype(np.int32)], [docs[order].tobytes()], [times[order].tobytes()])
        kinds = (pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["ids", "sizes", "terms", "found", "docs", "times"])


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """A row a window: `ids`, `sizes` (terms of each document, 8 bytes), and of the vocabulary's terms that occur in it
    the numbers `terms`, their document counts `found`, and their postings, one term after the other: place of the
    document in the window `docs` (2 bytes) and occurrences `times` (4 bytes). Documents without terms are left out."""

    def run(batches):
        known, window = vocabulary.keys(), _Open(size)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            data, offsets = buffers(batch.column("text"))
            for i, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True):
                terms = counted(data[a:b].tobytes())
                if not terms:
                    continue
                at, hits = len(window.ids), terms.keys() & known
                window.ids.append(i)
                window.sizes.append(terms.total())
                window.terms.extend(map(vocabulary.__getitem__, hits))
                window.times.extend(map(terms.__getitem__, hits))
                window.docs.extend([at] * len(hits))
                if window.full():
                    yield window.row()
                    window = _Open(size)
            trim()
        if window.ids:
            yield window.row()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _INDEX)


def _sizes_of(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("sizes")]
        yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in sizes], pa.int64()), pa.array([int(x.sum()) for x in sizes], pa.int64())], ["n", "l"])


def statistics(indexed: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and the number of documents that hold each of the vocabulary's terms."""
    total = indexed.select("sizes").mapInArrow(_sizes_of, "n bigint, l bigint").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    found = np.zeros(terms, np.int64)
    each = indexed.select(F.explode(F.arrays_zip("terms", "found")).alias("x")).select("x.terms", "x.found")
    for r in each.groupBy("terms").agg(F.sum("found").alias("n")).collect():  # a row a term of the block of items
        found[r["terms"]] = r["n"]
    return total["n"] or 0, total["l"] or 0, found


def term_weights(n: int, found: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in found.tolist()], np.int64)


def length_norms(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """Hundredths by which a document's length slows the growth of its terms' shares: 100 at the mean length."""
    if 25 * n * int(sizes.max(initial=0)) < 1 << 63:
        return 75 + 25 * sizes * n // total
    return np.array([75 + 25 * s * n // total for s in sizes.tolist()], np.int64)


class Item:
    """An item's terms with their repeats, and its heap of (score, negated id), the worst on top."""

    def __init__(self, terms: Counter, best: int):
        self.terms, self.repeats = np.int64(list(terms.keys())), np.int64(list(terms.values()))
        self.best, self.heap = best, []

    def harvest(self, scores: np.ndarray, ids: list) -> None:
        least = self.heap[0][0] if len(self.heap) == self.best else 1
        for at in np.flatnonzero(scores >= least).tolist():
            entry = (int(scores[at]), _NULL if ids[at] is None else -ids[at])
            if len(self.heap) < self.best:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def _scoring(items: list[Counter], weights: np.ndarray, n: int, total: int, best: int, size: int):
    def run(batches):
        asked = [Item(terms, best) for terms in items]
        place = np.full(len(weights), -1, np.int64)
        scores, touched = np.zeros(size, np.int64), np.zeros(-(-size // STRETCH), bool)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids")[k].as_py()
                sizes, docs, times = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("sizes", np.int64), ("docs", np.uint16), ("times", np.uint32)))
                terms, found = (np.asarray(batch.column(c)[k].values, np.int64) for c in ("terms", "found"))
                times, norm = times.astype(np.int64), length_norms(sizes, n, total)
                worth = np.repeat(weights[terms], found) * (1_000_000_000 * times // (1000 * times + 12 * norm[docs]))
                first = np.concatenate([[0], np.cumsum(found)])
                place[terms] = np.arange(len(terms))
                for item in asked:
                    at = place[item.terms]
                    here = at >= 0
                    if not here.any():
                        continue
                    for p, r in zip(at[here].tolist(), item.repeats[here].tolist(), strict=True):
                        hit = docs[first[p] : first[p + 1]]
                        scores[hit] += r * worth[first[p] : first[p + 1]]  # a document is once among a term's postings
                        touched[hit // STRETCH] = True
                    for s in np.flatnonzero(touched).tolist():
                        a = s * STRETCH
                        stretch = scores[a : a + STRETCH]
                        item.harvest(stretch, ids[a : a + STRETCH] + [None] * STRETCH)
                        stretch[:] = 0
                    touched[:] = False
                place[terms] = -1
        rows = [(k, -i if i != _NULL else None, s) for k, item in enumerate(asked) for s, i in item.heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The `best` documents of each row of `items`: item_col, rank (from 1), id_col, score.

    Only documents with a score above 0 are hits, equal scores go by the smaller id, null ids last. Null texts and texts
    without terms give no hits, on either side; rows that repeat an id are rows of their own, items as well. Ids are
    integers. Empty tables give no rows. Other columns of both tables are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks, out = -(-size // item_bytes), []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        vocabulary: dict[bytes, int] = {}
        terms = [Counter({vocabulary.setdefault(w, len(vocabulary)): n for w, n in counted(r["text"].encode()).items()}) for r in rows]
        indexed = stored(index(docs, vocabulary, id_col, text_col, window), "lexical-index")
        n, total, found = statistics(indexed, len(vocabulary))
        kept = stored(indexed.mapInArrow(_scoring(terms, term_weights(n, found), n, total, best, window), "item int, id bigint, score bigint"), "lexical-hits")
        drop(indexed)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        names = spark.createDataFrame([(k, r["id"]) for k, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", asked.schema["id"].dataType)]))
        out.append(ranked.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not out:
        return spark.createDataFrame([], T.StructType([T.StructField(item_col, asked.schema["id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionByName, out)


SQL = r"""
with w as (select 'd' as k, doc_id as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents
    union all select 'i', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) from benchmark),
p as (select k, id, t, count(*)::bigint as tf from w group by all),
d as (select id, sum(tf)::bigint as n from p where k = 'd' group by 1),
s as (select count(*)::bigint as docs, sum(n)::bigint as l from d),
m as (select id, 100 - 25 + (25 * n * docs) // l as m from d, s),
f as (select t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from p, s where k = 'd' group by 1),
h as (select i.id as item_id, d.id as doc_id, sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m)))::bigint as score
    from p i join f using (t) join p d using (t) join m on m.id = d.id where i.k = 'i' and d.k = 'd' group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from h where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20
"""
