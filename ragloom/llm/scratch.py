"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table there and reading it again, so a lost executor costs a re-read and
never a recomputation of earlier stages.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured bytes are at most this.
BROADCAST_BYTES = 16 << 20

#: Bytes of an Arrow batch to a Python worker, at most: JVM and worker hold several at a time.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only when it is unset and Spark runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="ragloom-"))
    return _LOCAL[0].name


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again. The session's Arrow batches are kept to BATCH_BYTES."""
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH).rstrip("bB") or 0) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Deletes what `stored` wrote for these frames, once nothing reads them any more.

    Spark deletes the shuffle files of finished jobs when the driver collects its garbage, which otherwise may be long after.
    """
    gc.collect()
    for df in frames[:1]:
        df.sparkSession.sparkContext._jvm.System.gc()
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, *blobs: str | Column, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if its measured size keeps to the limit, else as it is. `blobs`: columns of bytes or text, or expressions of bytes."""
    size = F.count(F.lit(1)) * row_bytes
    for c in blobs:
        size = size + F.coalesce(F.sum(F.length(c) if isinstance(c, str) else c), F.lit(0))
    return F.broadcast(df) if df.agg(size.alias("b")).first()["b"] <= limit else df
