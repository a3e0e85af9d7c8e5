"""Cutting a plan by a checkpoint that every executor can read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder; where none is set, one process alone gets a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if found := context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
            context.setCheckpointDir(found)
        elif context.master.startswith("local[") or context.master == "local":
            context.setCheckpointDir(tempfile.mkdtemp(prefix="ragloom-"))
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return context._jsc.sc().getCheckpointDir().get()


#: Bytes of an Arrow batch to a Python worker, at most: what it makes of a batch takes many times as much.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """The same frame; its session's Arrow batches are kept to BATCH_BYTES, however many rows that is."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_BATCH).rstrip("bB") or 0) <= BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)
    return df


def lasting(df: DataFrame) -> DataFrame:
    """The frame as written to the checkpoint folder."""
    folder(df.sparkSession)
    return bounded(df).checkpoint()
