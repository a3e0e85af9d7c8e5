"""Streams that fail after a batch and go on: results are as if nothing had happened."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from ragloom.operators.keyed import KeyedTable
from ragloom.streaming import incremental as I


@pytest.fixture
def events(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").select("event_id", (F.col("user_id") % 40).alias("user_id"), "ts").repartition(3).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


class Broken(Exception):
    pass


def failing(put, at):
    """Runs `put` and then fails in batch `at`, so that what it wrote is there and its batch is not done."""

    def run(rows, number):
        put(rows, number)
        if number == at:
            raise Broken

    return run


def test_keyed_sink_resumes(spark, events, tmp_path):
    rows = I.file_stream(spark, events, spark.read.parquet(events).schema).select("user_id", F.struct("ts", "event_id").alias("at"), F.lit(1).alias("n"))
    held = KeyedTable(spark, str(tmp_path / "t"))
    held.create(rows.schema, ["user_id"], buckets=4)
    put = failing(lambda r, k: held.upsert(r, newest="at", batch=("s", k)), 1)
    broken = rows.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="Broken"):
        I.finished(broken)
    assert held.manifest().batches == {"s": 1} and held.manifest().version == 2
    I.finished(I.into_keyed(rows, held, str(tmp_path / "c"), "s", newest="at"))
    assert held.manifest().batches == {"s": 2} and held.manifest().version == 3  # batch 1 came twice and counts once
    wanted = spark.read.parquet(events).groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    assert held.read().select("user_id", "at").exceptAll(wanted).count() == wanted.exceptAll(held.read().select("user_id", "at")).count() == 0
    # files that arrive later are the next batch
    spark.createDataFrame([(10**9, 7)], "event_id long, user_id long").withColumn("ts", F.expr("timestamp_ntz '2999-01-01'")).coalesce(1).write.mode("append").parquet(events)
    I.finished(I.into_keyed(rows, held, str(tmp_path / "c"), "s", newest="at"))
    assert held.read().where("user_id = 7").first()["at"]["event_id"] == 10**9 and held.manifest().version == 4


def test_state_resumes(spark, events, tmp_path):
    found = I.sights(I.file_stream(spark, events, spark.read.parquet(events).schema), ["user_id"])
    put = failing(lambda r, k: r.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={k}")), 1)
    broken = found.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="Broken"):
        I.finished(broken)
    I.finished(I.by_batch(found, str(tmp_path / "out"), str(tmp_path / "c")))
    got = {r["user_id"]: (r["n"], r["f"]) for r in I.read_batches(spark, str(tmp_path / "out"), found.schema).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum(F.col("is_first").cast("int")).alias("f")).collect()}
    assert got == {r["user_id"]: (r["count"], 1) for r in spark.read.parquet(events).groupBy("user_id").count().collect()}
    assert I.read_batches(spark, str(tmp_path / "out"), found.schema).select("batch").distinct().count() == 3


def test_question_stream_and_first_seen(spark, tmp_path):
    from ragloom.operators import serving

    (tmp_path / "q").mkdir()
    (tmp_path / "q/a.txt").write_text("one\ntwo\none\n")
    asked = I.first_seen(serving.question_stream(spark, str(tmp_path / "q")), "question")
    I.finished(I.by_batch(asked, str(tmp_path / "o"), str(tmp_path / "c")))
    assert sorted(r["question"] for r in I.read_batches(spark, str(tmp_path / "o"), asked.schema).collect()) == ["one", "two"]
