"""Queries that stream a given table from files, and whose results are those of the whole table at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.keyed import KeyedTable
from ragloom.operators.lasting import folder
from ragloom.plans.registry import query
from ragloom.sources.tables import table
from ragloom.streaming import incremental as I

#: Files that the streamed table is dealt to, files of a batch, and partitions of a stream's state.
_FILES, _EACH, _STATE = 6, 2, 16


def _streamed(spark: SparkSession, d: str) -> tuple[SparkSession, DataFrame, str]:
    """(a session of the stream's own, events as a stream of several batches, a folder for it)."""
    place = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "events").repartition(_FILES).write.parquet(f"{place}/events")
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(min(_STATE, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return own, I.file_stream(own, f"{place}/events", own.read.parquet(f"{place}/events").schema, _EACH), place


@query("SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def stream_latest(spark, d):
    """Each user's latest event, upserted batch by batch into a keyed table; batches come in any order."""
    own, events, place = _streamed(spark, d)
    rows = events.select("user_id", F.struct("ts", "event_id").alias("at"))
    held = KeyedTable(own, f"{place}/latest")
    held.create(rows.schema, ["user_id"], buckets=8)
    I.finished(I.into_keyed(rows, held, f"{place}/checkpoint", "events", newest="at"))
    return KeyedTable(spark, f"{place}/latest").read().select("user_id", "at.event_id", "at.ts")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS seen, CAST(1 AS BIGINT) AS first, CAST(CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS INT) AS crawled FROM events GROUP BY user_id")
def stream_sights(spark, d):
    """How often each user is seen, the sights that were the first, and the mark that a repeated sight sets, by state over batches."""
    own, events, place = _streamed(spark, d)
    found = I.sights(events, ["user_id"])
    I.finished(I.by_batch(found, f"{place}/sights", f"{place}/checkpoint"))
    rows = I.read_batches(spark, f"{place}/sights", found.schema)
    again = F.max(F.when(~F.col("is_first") | (F.col("n") > 1), 1).otherwise(0))
    return rows.groupBy("user_id").agg(F.sum("n").alias("seen"), F.sum(F.col("is_first").cast("long")).alias("first"), again.alias("crawled"))
