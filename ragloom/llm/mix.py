"""Mixing of sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

All of it is DataFrame and SQL functions. The table of sources and the threshold of each source are small;
the documents are read once for their sizes and once for the decision, and no source meets in one task:
within a source, documents are ordered by a seeded hash, sums over hash buckets find the one bucket where
the target is reached, and only that bucket is ordered exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.scratch import stored

# fixed values: the characters that part words
_WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded hash that name a bucket: 4,096 buckets a source.
_DIGITS = 3


def _hash(seed: str, id_col: Column) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def _filled(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """(source, source_size, target) of (source, source_size): one row a source, so windows over all of them stay small."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    # at water level L a source takes min(cap, w·L); sources in the order in which they reach their caps
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    filled = ranked.withColumn("cap", F.col("source_size") * epochs).select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(share)).alias("total"),
        F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("below"),
        F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("above"),
    )
    # capped where the level at which it is full needs no more than there is
    full = F.col("below") - F.col("cap") + F.col("cap") / F.col("w") * F.col("above") <= F.col("total")
    filled = filled.withColumn("full", full)
    rest = F.max("total").over(whole) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    heavy = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest * F.col("w") / heavy)
    return filled.select("source", "source_size", target.alias("target"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix-1",
    carry: list[str] | None = None,
) -> DataFrame:
    """The rows (columns in `carry`, all by default) with size, source_size, target, times and taken.

    `size` is the number of words of the text (null: 0). Sources by code point, null last, weigh `weights`, repeating;
    together they take `share` times all words; a source stops at `epochs` times its size, and the excess goes to the
    others by weight until none is above. A document is taken `times` times: the whole part of target / source_size for
    all of its source, and once more for the first of them by a seeded hash of the id until the target is reached, to
    the nearest document. Rows of equal id are taken alike; a null id hashes as an empty one. Empty sources and empty
    tables give targets of 0 and no rows. Columns of the input named like the new ones are replaced.
    """
    new = ("size", "source_size", "target", "times", "taken")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long")
    sized = stored(docs.select(F.col(source_col).alias("source"), size.alias("size"), _hash(seed, F.col(id_col)).alias("h")), "mix-sizes")
    return _decided(docs, sized, carry, source_col, size, _hash(seed, F.col(id_col)), weights, share, epochs)


def _decided(docs: DataFrame, sized: DataFrame, carry: list[str], source_col: str, size: Column, h: Column, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    buckets = sized.groupBy("source", F.substring("h", 1, _DIGITS).alias("b")).agg(F.sum("size").alias("s"))
    plan = stored(_filled(buckets.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, epochs), "mix-plan")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", times).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # the bucket in which the words of the source, by hash, reach the rest
    at = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = buckets.withColumn("upto", F.sum("s").over(at))
    edge = _same(reached.alias("r"), plan.alias("p"), F.col("r.source"), F.col("p.source")).where((F.col("upto") >= F.col("rest")) & (F.col("rest") > 0))
    edge = edge.groupBy(F.col("r.source").alias("source")).agg(F.min_by(F.struct("b", (F.col("upto") - F.col("s")).alias("before"), "rest"), "b").alias("e")).select("source", "e.*")
    edge = stored(edge, "mix-edges")  # a row a source: its size is known, and Spark broadcasts it where it is small
    # within it, document by document
    near = _same(sized.alias("d"), edge.alias("e"), F.col("d.source"), F.col("e.source")).where(F.substring("d.h", 1, _DIGITS) == F.col("e.b"))
    near = near.groupBy(F.col("d.source").alias("source"), "h", "b", "before", "rest").agg(F.sum("size").alias("s"))
    order = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("middle", 2 * F.col("before") + 2 * F.sum("s").over(order) - F.col("s"))
    last = near.groupBy("source").agg(F.max(F.when(F.col("middle") <= 2 * F.col("rest"), F.col("h"))).alias("h"), F.min("b").alias("b"))
    # hashes below the edge bucket and up to the last taken in it
    limit = last.select(F.col("source").alias("ls"), F.coalesce("h", "b").alias("last"))
    plan = plan.join(limit, F.col("source").eqNullSafe(F.col("ls")), "left").select(F.col("source").alias("ps"), "source_size", "target", "whole", "last")
    plan = stored(plan, "mix-limits")
    full = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.col(source_col).alias("ds"), size.alias("size"), h.alias("h"))
    full = full.join(plan, F.col("ds").eqNullSafe(F.col("ps")))
    taken = F.col("whole") + F.coalesce((F.col("h") <= F.col("last")).cast("long"), F.lit(0))
    full = full.withColumn("times", taken)
    return full.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def _same(a: DataFrame, b: DataFrame, x: Column, y: Column) -> DataFrame:
    return a.join(b, x.eqNullSafe(y))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The input's columns, each row as often as the mix takes it."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    options = {"id_col": "doc_id", "source_col": "source", "text_col": "text"} | options
    plain = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    out = mixed(plain, **options | {k: names[options[k]] for k in ("id_col", "source_col", "text_col")})
    out = out.where("times > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


#: DuckDB's form of the query op4 (default parameters).
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)] AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total,
         sum(2 * source_size) OVER o - 2 * source_size AS below, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
  FROM s WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source IS NULL, source)),
g AS (SELECT *, CAST(below AS DOUBLE) + CAST(cap AS DOUBLE) / w * CAST(above AS DOUBLE) <= total AS full FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN "full" THEN CAST(cap AS DOUBLE)
              ELSE (max(total) OVER () - CAST(coalesce(sum(CASE WHEN "full" THEN cap END) OVER (), 0) AS DOUBLE)) * w
                   / CAST(sum(CASE WHEN NOT "full" THEN w END) OVER () AS DOUBLE) END AS target
  FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
m AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         2 * sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           - sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS middle
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND CAST(middle AS DOUBLE) <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""
