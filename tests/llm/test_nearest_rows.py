"""op9 on rows of other kinds: tight clusters, queries unlike the rows, and numbers beyond single precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import ann
from test_nearest import exact


def tight(draw, n):
    x = draw.normal(size=(40, 64))[draw.integers(0, 40, n)] + 0.02 * draw.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1)[:, None]


def apart(draw, n):
    x = draw.normal(size=(50, 64))[draw.integers(0, 50, n)] + 0.2 * draw.normal(size=(n, 64))
    x[::20] = draw.normal(size=(len(x[::20]), 64))
    return x


def huge(draw, n):
    return draw.normal(size=(n, 64)) * 1e60


@pytest.mark.parametrize("made", [tight, apart, huge])
def test_recall_on_other_rows(spark, made):
    x, ids = made(np.random.default_rng(5), 20_000), np.arange(20_000)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    wanted, got = exact(ids, x, np.flatnonzero(ids % 200 == 0)), {}
    for r in ann.neighbours(vectors, vectors.where("vec_id % 20 = 0")).where(F.col("query_id") % 200 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == wanted.keys() and np.mean([len(got[q] & wanted[q]) / 20 for q in wanted]) >= 0.94
