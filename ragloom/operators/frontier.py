"""The crawl frontier: what to visit next, what is known, and the spread of links to a depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.operators.lasting import lasting

#: Deepest level whose pages are still expanded.
MAX_DEPTH = 5


def frontier(urls: DataFrame, flag: str = "crawled", depth: str = "depth") -> DataFrame:
    """Rows not crawled yet at the least depth of such rows; none if all are crawled."""
    open_ = urls.where(F.col(flag) == 0)
    return open_.where(F.col(depth) == open_.agg(F.min(depth)).scalar())


def pending(rows: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is 0."""
    return rows.where(F.col(flag) == 0)


def unknown(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Candidates, each key once, that are not among the known; a null key never is one."""
    return candidates.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known.select(key), key, "left_anti")


def inserted_or_ignored(known: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both, with the first row of each key: a known one before new ones, and of new ones the first by `order`."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = Window.partitionBy(key).orderBy("_new", order)
    return both.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", "_new")


def marked(rows: DataFrame, done: DataFrame, key: str, **values) -> DataFrame:
    """Rows whose key is in `done` get the given column values."""
    hit = done.select(F.col(key).alias("_key")).distinct()
    out = rows.join(hit, F.col(key) == F.col("_key"), "left")
    for c, v in values.items():
        out = out.withColumn(c, F.when(F.col("_key").isNotNull(), v if hasattr(v, "cast") else F.lit(v)).otherwise(F.col(c)))
    return out.drop("_key")


def with_last_flag(links: DataFrame, parent: str, link: str) -> DataFrame:
    """`is_last`: 1 for the greatest link of each parent."""
    at = Window.partitionBy(parent).orderBy(F.desc(link))
    return links.withColumn("is_last", (F.row_number().over(at) == 1).cast("int"))


def completed(links: DataFrame, done: DataFrame, parent: str, link: str) -> DataFrame:
    """Parents all of whose links are done."""
    seen = links.join(done.select(F.col(link)).distinct().withColumn("_done", F.lit(1)), link, "left")
    return seen.groupBy(parent).agg(F.min(F.coalesce("_done", F.lit(0))).alias("complete")).where("complete = 1").select(parent)


def spread(seeds: DataFrame, edges: DataFrame, keep=None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(url, parent, depth) of every page reachable from the seeds, at its least depth, with its least parent there.

    `edges` are (parent, child). Pages at `max_depth` are not expanded. `keep` is a Boolean column on (url) for links
    to follow. Each level joins the edges once and leaves out what is known; levels are written to the checkpoint
    folder, so that plans stay short and no level is computed again.
    """
    known = seeds.select("url").distinct().select("url", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    level = known
    for depth in range(1, max_depth + 1):
        step = level.select(F.col("url").alias("_from")).join(edges, F.col("_from") == F.col("parent")).groupBy(F.col("child").alias("url")).agg(F.min("parent").alias("parent"))
        if keep is not None:
            step = step.where(keep)
        level = lasting(step.join(known.select("url"), "url", "left_anti").select("url", "parent", F.lit(depth).alias("depth")))
        known = known.union(level)
    return known
