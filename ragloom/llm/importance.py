"""Importance resampling towards a target distribution, by hashed n-grams and an external sort-count.

One scan writes every document's features as a packed stream of 16-bit buckets with the documents' sizes. Each stored
stream is sorted and run-length encoded for its counts, and Spark sums the runs. The gains of all buckets (one number
a bucket) are then gathered along the streams, and a sum over each document's stretch gives its weight. Seeded Gumbel
noise on the weights makes the highest scores a draw without replacement.

The ranks of the draw need no single task: a count of each score (scores are whole numbers within some ten thousands)
gives the least score drawn, rows from there on are dealt by ranges of (score, id), and a row's rank is its place in its
range after the sizes of the ranges before it.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.scratch import drop, stored
from ragloom.llm.terms import runs
from ragloom.llm.textwords import buffers, trim

#: Buckets of features, longest run of words that is a feature, words that a drawn document has at least.
BUCKETS, LONGEST, LEAST_WORDS = 10_000, 1, 20
#: Percent of the documents that are drawn; seed of the noise.
PERCENT, SEED = 10, "2024"
#: Features whose buckets are remembered between texts.
KEPT = 1 << 19


class _Buckets(dict):
    """The bucket of a feature's bytes, remembered for up to KEPT features."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(raw: bytes, longest: int, bucket) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of 1 to `longest` consecutive words."""
    n_words, found, before = 0, [], []
    for words in runs(raw):
        n_words += len(words)
        found.append(np.fromiter(map(bucket, words), np.uint16, len(words)))
        for n in range(2, longest + 1):
            line = before[len(before) - min(n - 1, len(before)) :] + words
            grams = list(map(b" ".join, zip(*(line[j:] for j in range(n)), strict=False)))
            found.append(np.fromiter(map(bucket, grams), np.uint16, len(grams)))
        before = (before + words)[-(longest - 1) :] if longest > 1 else []
    return n_words, np.concatenate(found) if found else np.zeros(0, np.uint16)


def streams(docs: DataFrame, carry: list[str], text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Packed streams: carried columns c0, c1 … as arrays of rows, `words` and `sizes` (8 bytes a row), `stream` (2 bytes a feature)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is a 16-bit number")
    part = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*(T.StructField(f"c{i}", T.ArrayType(part.schema[f"c{i}"].dataType)) for i in range(len(carry))), *(T.StructField(n, T.BinaryType()) for n in ("words", "sizes", "stream"))])

    def run(batches):
        bucket = _Buckets(buckets).__getitem__
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column("text"))
            found = [features(data[a:b].tobytes(), longest, bucket) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            whole = pa.array([0, batch.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, batch.column(f"c{i}")) for i in range(len(carry))]
            blobs = (np.int64([n for n, _ in found]), np.int64([len(x) for _, x in found]), np.concatenate([x for _, x in found]))
            yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], schema.names)
            trim()

    return part.mapInArrow(run, schema)


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: every stream is sorted and run-length encoded, tasks add their runs up, Spark sums the tasks'."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("stream"):
                line = np.sort(np.frombuffer(x.as_buffer(), np.uint16), kind="stable")
                first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])[: len(line)])
                total[line[first]] += np.diff(first, append=len(line))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in packed.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: the floored thousandfold logarithm of its smoothed share in the target over that in the corpus."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """Carried columns, `n_words`, `n_features` and `weight`, the floored mean gain of the features (0 without any)."""
    names = [n for n in packed.columns if n not in ("words", "sizes", "stream")]
    schema = T.StructType([*(T.StructField(n, packed.schema[n].dataType.elementType) for n in names), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                n_words, sizes = (np.frombuffer(row.column(n)[0].as_buffer(), np.int64) for n in ("words", "sizes"))
                stream = np.frombuffer(row.column("stream")[0].as_buffer(), np.uint16)
                some = np.flatnonzero(sizes)
                weight = np.zeros(len(sizes), np.int64)
                if len(some):
                    weight[some] = np.add.reduceat(gain[stream], (np.cumsum(sizes) - sizes)[some]) // sizes[some]
                yield pa.RecordBatch.from_arrays([*(row.column(n).flatten() for n in names), *map(pa.array, (n_words, sizes, weight))], schema.names)

    return packed.mapInArrow(run, schema)


def noise(id_col: Column, seed: str = SEED) -> Column:
    """Seeded Gumbel noise of an id, in floored thousandths. A null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


@dataclass
class Draw:
    """The least score drawn (None: nothing is) and how many rows are."""

    least: int | None
    size: int


def draw_of(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> Draw:
    """From the counts of each score: scores are sums of two bounded whole numbers, so there are some ten thousand of them at most."""
    counts = {r["score"]: r["n"] for r in scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    size, above = percent * sum(counts.values()) // 100, 0
    for score in sorted(counts, reverse=True) if size else ():
        above += counts[score]
        if above >= size:
            return Draw(score, size)
    return Draw(None, 0)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    carry: list[str] | None = None,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """Every row of `docs` (the id, then the columns in `carry`) with n_words, n_features, weight, score and rank.

    `rank` is 1, 2, 3 … for the drawn rows, in the order of falling scores, ties to the smaller id, null ids last; null
    for the others. Null and empty texts have no features, weight 0, and are never drawn while least_words is above 0.
    Rows that repeat an id share its noise and each count; of wholly equal rows any comes first. An empty target, or none
    in common, is met by the smoothing; an empty table gives an empty result. Carried columns named like a new one are left out.
    """
    new = ("n_words", "n_features", "weight", "score", "rank")
    keep = [id_col, *(c for c in (carry or []) if c != id_col and c not in new)]
    packed = stored(streams(docs, keep, text_col, buckets, longest), "importance-streams")
    gain = gains(bucket_counts(packed, buckets), bucket_counts(streams(target, [], target_col, buckets, longest), buckets))
    scored = weights(packed, gain)
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col("c0"), seed)), "importance-scores")
    drop(packed)
    draw = draw_of(scored, least_words, percent)
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    rest = [F.col(c) for c in new[:-1]]
    if draw.least is None:
        return scored.select(*names, *rest, F.lit(None).cast("long").alias("rank"))
    high = (F.col("n_words") >= least_words) & (F.col("score") >= draw.least)
    # the last key parts rows that are equal in all others over several ranges
    order = [F.col("score").desc(), F.col("c0").asc_nulls_last(), F.col("part").asc()]
    top = scored.where(high).withColumn("part", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    top = stored(top.drop("part").select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "importance-ranges")
    sizes = sorted((r["range"], r["n"]) for r in top.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = docs.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(sizes, before, strict=False)], "range int, before long")
    rank = F.col("before") + F.col("place") + 1
    top = top.join(F.broadcast(starts), "range").select(*names, *rest, F.when(rank <= draw.size, rank).alias("rank"))
    return scored.where(~high).select(*names, *rest, F.lit(None).cast("long").alias("rank")).unionByName(top)


SQL = r"""
with recursive tab as (select list(c order by i) as t from (
    select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) r(i))),
w as (select 'd' as k, doc_id as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as f from documents
    union all select 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
n as (select k, id, f, count(*) as c from w group by all),
u as (select f, xor(list_reduce(list_prepend(4294967295::bigint, [(('0x' || h)::bigint) for h in regexp_extract_all(hex(encode(f)), '..')]),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 as bucket from (select distinct f from n), tab),
b as (select bucket, coalesce(sum(c) filter (k = 'd'), 0)::double as s, coalesce(sum(c) filter (k = 'b'), 0)::double as t from n join u using (f) group by 1),
a as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from b),
g as (select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from b, a),
d as (select id, sum(c)::bigint as n, floor(sum(c * gain)::double / sum(c))::bigint as weight from n join u using (f) join g using (bucket) where k = 'd' group by 1),
e as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || doc_id::varchar), 1, 8))::bigint as h from documents left join d on id = doc_id),
r as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from e),
p as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as p, 10 * count(*) over (partition by n_features >= 20) // 100 as size from r)
select doc_id, n_features, weight, score, case when n_features >= 20 and p <= size then p end as rank from p
"""
