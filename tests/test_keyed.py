"""Keyed tables: values after upserts, buckets left alone, two writers, repeated batches."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ragloom.operators.keyed import KeyedTable, Manifest, Taken

SCHEMA = "id long, kind string, text string, at int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def made(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"))
    table.create(SCHEMA, ["id", "kind"], buckets=16)
    return table


def test_values(spark, made):
    assert made.read().count() == 0 and made.create(SCHEMA, ["id"]).key == ["id", "kind"]
    made.upsert(frame(spark, [(1, "a", "one", 1), (1, "b", "two", 1), (None, "a", "none", 1), (2, "a", None, 1)]))
    made.upsert(frame(spark, [(1, "a", "new", 2), (3, "c", "three", 2), (None, "a", "again", 2), (4, "d", "x", 1), (4, "d", "y", 1)]).withColumn("more", F.lit(1)))
    assert rows_of(made.read()) == sorted([(1, "a", "new", 2), (1, "b", "two", 1), (None, "a", "again", 2), (2, "a", None, 1), (3, "c", "three", 2), (4, "d", "y", 1)], key=str)
    assert made.read(1).count() == 4 and made.versions() == [0, 1, 2]
    made.upsert(frame(spark, [(1, "a", "older", 1), (2, "a", "newer", 9), (5, "e", "e", 0)]), newest="at")
    got = {r[:2]: r[2:] for r in rows_of(made.read())}
    assert got[1, "a"] == ("new", 2) and got[2, "a"] == ("newer", 9) and got[5, "e"] == ("e", 0)
    made.upsert(frame(spark, [(2, "a", "part", 0), (6, "f", "f", 3)]), update=["text"])
    got = {r[:2]: r[2:] for r in rows_of(made.read())}
    assert got[2, "a"] == ("part", 9) and got[6, "f"] == ("f", 3)
    before = made.versions()[-1]
    made.upsert(frame(spark, []))
    assert made.versions()[-1] == before + 1 and made.vacuum() > 0 and len(made.versions()) == 2 and len({r[:2] for r in rows_of(made.read())}) == 8


def test_only_touched_buckets_are_rewritten(spark, made, tmp_path):
    made.upsert(spark.range(20_000).select("id", F.lit("k").alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit(1).alias("at")))
    first = made.manifest()
    size = lambda m, old: sum(f.stat().st_size for b, p in m.parts.items() if old is None or old.parts[b] != p for f in Path(made.path, p).glob("*.parquet"))
    second = made.upsert(frame(spark, [(7, "k", "new", 2)]))
    assert sum(second.parts[b] != first.parts[b] for b in first.parts) == 1 and len(first.parts) == 16
    assert size(second, first) < size(second, None) / 10
    third = made.upsert(frame(spark, [(i, "k", "new", 2) for i in range(40)]))
    assert size(third, second) > 3 * size(second, first)
    assert made.read().count() == 20_000 and made.read().where("text = 'new'").count() == 40


def test_a_version_is_taken_once(spark, made):
    base, won, lost = made.manifest(), [], []

    def write(k):
        try:
            made.commit(Manifest(1, base.key, base.buckets, base.schema, {}, {f"w{k}": k}))
            won.append(k)
        except Taken:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7 and made.manifest().batches == {f"w{won[0]}": won[0]}


def test_writers_side_by_side_lose_nothing(spark, made):
    failed = []

    def write(k):
        try:
            for j in range(3):  # keys of their own and one that all write
                KeyedTable(spark, made.path).upsert(frame(spark, [(100 * k + j, "k", f"{k}-{j}", j), (5000, "k", f"{k}", 10 * j + k)]), newest="at")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and made.versions()[-1] == 9
    got = {r[0]: r[2] for r in rows_of(made.read())}
    assert got == {100 * k + j: f"{k}-{j}" for k in range(3) for j in range(3)} | {5000: "2"}


def test_repeated_batches(spark, made):
    one = frame(spark, [(1, "a", "x", 1)])
    made.upsert(one, batch=("s", 0))
    made.upsert(frame(spark, [(1, "a", "y", 1)]), batch=("s", 0))
    assert rows_of(made.read()) == [(1, "a", "x", 1)] and made.manifest().batches == {"s": 0}
    made.upsert(frame(spark, [(1, "a", "z", 1)]), batch=("other", 0))
    assert rows_of(made.read()) == [(1, "a", "z", 1)]
    with pytest.raises(ValueError):
        KeyedTable(spark, made.path + "-none").read()
