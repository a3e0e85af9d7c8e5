"""Incremental synchronisation between tables: watermarks, lookups, upserts and write-backs, set by set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.operators.lasting import lasting

# fixed value: the watermark of an empty target
EPOCH = "2000-03-25 18:07:12.922654"


def watermark(target: DataFrame, ts: str, default: str = EPOCH) -> DataFrame:
    """One row: the greatest time of the target, or the default."""
    return target.agg(F.coalesce(F.max(ts), F.to_timestamp(F.lit(default))).alias("watermark"))


def after_watermark(source: DataFrame, mark: DataFrame, ts: str) -> DataFrame:
    """Source rows later than the watermark; rows equal to it were taken before."""
    return source.where(F.col(ts) > mark.select("watermark").scalar())  # a scalar subquery, so that the scan gets the filter


def looked_up(rows: DataFrame, other: DataFrame, key: str, other_key: str, value: str, into: str) -> DataFrame:
    """`into`: the other table's value for the key, null when there is none; the least where there are several."""
    found = other.groupBy(F.col(other_key).alias("_key")).agg(F.min(value).alias(into))
    return rows.join(found, F.col(key) == F.col("_key"), "left").drop("_key")


def upserted(target: DataFrame, source: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Target rows with the `update` columns of source rows of equal key, and source rows of new keys whole."""
    t, s = target.alias("t"), source.alias("s")
    has = F.col(f"t.{key}").isNotNull()
    pick = lambda c: F.when(F.col(f"s.{key}").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) if c in update else F.when(has, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer").select(*(pick(c).alias(c) for c in target.columns))


def appended_new(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target rows and the source rows of keys it lacks, so that a repeated run adds nothing."""
    return target.unionByName(source.join(target.select(key), key, "left_anti").select(*target.columns))


def written_back(rows: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with new values of the columns where a result has them."""
    new = results.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(new, F.col(key) == F.col("_key"), "left")
    return out.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def refreshed_vectors(target: DataFrame, source: DataFrame, key: str, text: str, flag: str = "vector") -> DataFrame:
    """Upsert of cleaned text; the vector flag goes back to 0 where the text changed."""
    old = target.select(F.col(key).alias("_key"), F.col(text).alias("_old"), F.col(flag).alias("_flag"))
    out = upserted(target, source, key, [text]).join(old, F.col(key) == F.col("_key"), "left")
    same = F.col(text).eqNullSafe(F.col("_old"))
    return out.withColumn(flag, F.when(F.col("_key").isNotNull() & same, F.col("_flag")).otherwise(F.lit(0))).drop("_key", "_old", "_flag")


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that hold the constraint, the others); unknown counts as not."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def batch_progress(rows: DataFrame, order: str, size: int = 500) -> DataFrame:
    """(batch, done, total): rows done after each batch of `size`, by ids. Counts per id range come first, so no task orders all rows."""
    ranked = numbered(rows.select(order), order)
    counts = ranked.groupBy(F.floor((F.col("rn") - 1) / size).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a batch
    return counts.select("batch", F.sum("n").over(upto).alias("done"), F.sum("n").over(Window.partitionBy()).alias("total"))


def numbered(rows: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """`rn`: the row's place by `order`, from 1, without bringing all rows into one task; equal values in any order.

    Rows are sorted over range partitions, as many as the session shuffles to unless given; the partitions' counts, one
    row each, give the offsets.
    """
    parted = rows.repartitionByRange(order) if ranges is None else rows.repartitionByRange(ranges, order)
    # both uses see one partitioning, also where a lost executor's part is made again
    parted = lasting(parted.sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    within = Window.partitionBy("_p").orderBy(order)
    placed = parted.withColumn("_i", F.row_number().over(within))
    counts = parted.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_p").alias("_q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), F.col("_p") == F.col("_q")).withColumn("rn", F.col("_i") + F.col("_before")).drop("_p", "_q", "_i", "_before")  # at most `ranges` rows


def take_while(rows: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Each group's rows before its first null in the column."""
    stop = F.min(F.when(F.col(column).isNull(), F.col(order))).over(Window.partitionBy(group))
    return rows.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")
