"""Sitemap indexes, their child maps, and the addresses in these: XML by Spark, indexes joined to their maps in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators.lasting import lasting

#: Levels of indexes within indexes that are followed at most; the protocol has one.
LEVELS = 8
_SHAPE = "sitemap array<struct<loc:string>>, url array<struct<loc:string>>"


def entries(maps: DataFrame, loc: str = "loc", xml: str = "xml") -> DataFrame:
    """(loc, is_index, entry, place) of each entry of each map, in its order; a map that is no XML has none."""
    read = F.from_xml(F.col(xml), _SHAPE, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    one = lambda c, index: F.transform(F.coalesce(c, F.array().cast("array<struct<loc:string>>")), lambda e, i: F.struct(F.lit(index).alias("is_index"), F.trim(e["loc"]).alias("entry"), i.alias("place")))
    parts = maps.select(F.col(loc).alias("loc"), read.alias("_x")).select("loc", F.explode(F.concat(one(F.col("_x.sitemap"), True), one(F.col("_x.url"), False))).alias("_e"))
    return parts.select("loc", "_e.*").where(F.coalesce(F.col("entry"), F.lit("")) != "")


def reached(maps: DataFrame, root: str, loc: str = "loc", xml: str = "xml") -> DataFrame:
    """(sitemap, url, place): the addresses of all maps that lead from the root's index, each map once however often it is named.

    A root that is a map itself is its own sitemap; indexes that name each other end; maps that are not there give nothing.
    """
    found = lasting(entries(maps, loc, xml))
    front = maps.sparkSession.createDataFrame([(root,)], "map string")
    seen, links = front, found.where("is_index").select(F.col("loc").alias("map"), F.col("entry").alias("to"))
    for _ in range(LEVELS):
        front = lasting(front.join(links, "map").select(F.col("to").alias("map")).distinct().join(seen, "map", "left_anti"))
        if front.isEmpty():
            break
        seen = lasting(seen.unionByName(front))
    return found.where("not is_index").join(seen.select(F.col("map").alias("loc")), "loc").select(F.col("loc").alias("sitemap"), F.col("entry").alias("url"), "place")
