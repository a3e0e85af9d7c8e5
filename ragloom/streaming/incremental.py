"""Structured Streaming forms: incremental upserts by micro-batch, first sight of each key by state, sinks that repeated batches leave as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragloom.operators.keyed import KeyedTable


def synced(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, key: str, ts: str) -> StreamingQuery:
    """Calls `apply` with each micro-batch's latest row per key; the checkpoint is the watermark, so a restart repeats at most one batch.

    `apply` must be idempotent (an upsert by key).
    """

    def batch(rows: DataFrame, _: int) -> None:
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        last = Window.partitionBy(key).orderBy(F.desc(ts))
        apply(rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, ts: str | None = None, within: str = "1 day") -> DataFrame:
    """Rows whose key was not seen before; with an event time, state is kept for the time given and no longer."""
    if ts is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def into_keyed(stream: DataFrame, table: KeyedTable, checkpoint: str, name: str, newest: str | None = None, update: list[str] | None = None) -> StreamingQuery:
    """Upserts each batch into a keyed table under the stream's name and the batch's number.

    A batch that is run again after a failure finds its number in the table and changes nothing, so each counts once.
    The table must be of the stream's session.
    """

    def put(rows: DataFrame, number: int) -> None:
        table.upsert(rows, update=update, newest=newest, batch=(name, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sights(stream: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, is_first, n): of each batch and key whether the key was never seen before, and its rows in the batch.

    The state of a key is the number of its rows so far; a batch's rows of a key are counted as they come, not held.
    Null keys are one key.
    """
    out = T.StructType([*(stream.schema[k] for k in keys), T.StructField("is_first", T.BooleanType()), T.StructField("n", T.LongType())])

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, n = state.get[0] if state.exists else 0, sum(map(len, parts))
        state.update((before + n,))
        yield pd.DataFrame([[*key, before == 0, n]], columns=out.fieldNames())

    return stream.select(*keys).groupBy(*keys).applyInPandasWithState(count, out, "seen long", "append", GroupStateTimeout.NoTimeout)


def by_batch(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch to a folder of its own number in place of what a failed run left there; `read_batches` reads them."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows that by_batch wrote, with their `batch`."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", folder).parquet(folder)


def finished(query: StreamingQuery) -> None:
    """Waits for a stream to the end of what there is; its failure is raised."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
