"""op9: the sample's size, lists that hold fewer than k rows, and recall of the registered query on the given table."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF
from ragloom.llm import ann, queries


def exact(ids, x, asked, k=20):
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    return {int(ids[a]): set(ids[np.lexsort((ids, -s))[:k]].tolist()) for a, s in zip(asked, score)}


def test_recall_of_the_query(spark):
    for sf in (SF, SF.replace("0.001", "0.1")):
        rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
        ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
        wanted, got = exact(ids, x, np.flatnonzero(ids % 20 == 0)), {}
        for r in queries.op9_nearest(spark, sf).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert got.keys() == wanted.keys() and all(len(v) == 20 for v in got.values())
        assert np.mean([len(got[q] & wanted[q]) / 20 for q in wanted]) >= 0.9


def test_tiny_lists_give_all_that_is_asked(spark):
    draw = np.random.default_rng(6)
    middle = draw.normal(size=(30, 16)) * 10
    x = np.concatenate([middle[c] + draw.normal(size=(300 if c < 20 else 3, 16)) for c in range(30)])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(6000, x[6000].tolist())] * 30, "vec_id long, embedding array<double>").repartition(5)
    asked = vectors.where("vec_id % 100 = 0 or vec_id >= 6000").distinct()
    many = {r["query_id"]: r["count"] for r in ann.neighbours(vectors, asked).groupBy("query_id").count().collect()}
    assert set(many.values()) == {20} and len(many) == asked.count()


def test_sample_is_bounded_in_the_driver(spark):
    rows = spark.range(0, 60_000, 1, 40).select("id", F.encode(F.col("id").cast("string"), "utf-8").alias("v"))
    rows = rows.unionByName(spark.range(20_000).select(F.lit(1).cast("long").alias("id"), F.lit(b"1").alias("v")))
    found = ann._sample(rows, 80_000, 500)
    assert len(found) <= 500 and len(set(found)) == len(found) > 300 and found == ann._sample(rows.repartition(7), 80_000, 500)
    assert len(ann._sample(rows, 80_000, 100_000)) == 60_000
