"""Tables of a data folder, settings, sitemaps and stored indexes."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the schemas of the crawl and content tables
URLS = T.StructType([T.StructField("url", T.StringType(), False), T.StructField("parents", T.StringType()), T.StructField("crawled", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("content", T.IntegerType()), T.StructField("last_modified", T.TimestampType())])
CONTENTS = T.StructType([T.StructField("url", T.StringType()), T.StructField("paragraph", T.StringType()), T.StructField("type", T.StringType()), T.StructField("last_modified", T.TimestampType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def setting(key: str, default: str | None = None, required: bool = False) -> str | None:
    """A setting from the environment; a required one that is missing or blank is an error."""
    value = os.environ.get(key, default)
    if required and not (value or "").strip():
        raise ValueError(f"{key} is not set")
    return value


def unchunked_pages(rows: DataFrame, mark: str, text: str = "paragraph", kind: str = "type", flag: str = "chunking") -> DataFrame:
    """Pages that hold the mark of an article and were not chunked yet."""
    return rows.where((F.col(kind) == "url") & (F.col(flag) == 0) & F.col(text).contains(mark))


def unchunked_files(rows: DataFrame, suffix: str, path: str = "paragraph", kind: str = "type", flag: str = "chunking") -> DataFrame:
    """Files of a suffix, in any case, that were not chunked yet."""
    return rows.where((F.col(kind) == "file") & (F.col(flag) == 0) & F.lower(path).endswith(suffix.lower()))


def sitemap_urls(xml: Column) -> Column:
    """The `loc` entries of a sitemap or a sitemap index."""
    return F.xpath(F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', ""), F.lit("//loc/text()"))


def sitemap_counts(found: DataFrame, known: DataFrame) -> DataFrame:
    """(sitemap, total, new), and the grand total with a null sitemap, of (sitemap, url) against known urls."""
    flagged = found.join(known.select("url").distinct().withColumn("_known", F.lit(1)), "url", "left")
    return flagged.rollup("sitemap").agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("new"))


def jdbc(spark: SparkSession, url: str, name: str, after: tuple[str, str] | None = None, **options) -> DataFrame:
    """A table of a relational store, from a time on where `after` is (column, time); credentials come from `options`."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return rows if after is None else rows.where(F.col(after[0]) > F.to_timestamp(F.lit(after[1])))
