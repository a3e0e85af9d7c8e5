"""Search by matrices with and without blocks, and passages looked up by their rarest shingle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ragloom.operators import retrieval as R


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_scanning_equals_pairs(spark, monkeypatch, few):
    draw = np.random.default_rng(3)
    made = draw.normal(size=(400, 8)).astype("float32")
    made[20:60] = made[20]  # many equal vectors
    frame = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(made)] + [(500, None, 1)], "id long, vec array<float>, kind int").repartition(3)
    asked = frame.where("vec is not null and id % 3 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    for by in ((), ("kind",)):
        wanted = rows(R.top_k(asked, frame.where("vec is not null"), 5, by=by, skip_self=True))
        assert rows(R.top_k_blocks(asked, frame, 5, by=by, skip_self=True, few=few)) == wanted
    assert R.top_k_blocks(asked.limit(0), frame, 5).count() == R.top_k_blocks(asked, frame.limit(0), 5).count() == 0
    assert R.top_k_blocks(asked, frame, 1000, few=few).count() == asked.count() * 400


def test_bounds_hold_over_blocks():
    draw = np.random.default_rng(4)
    q, v, least = draw.normal(size=(7, 4)), draw.normal(size=(900, 4)), {}
    seen = [set() for _ in q]
    for a in range(0, 900, 100):
        i, j, _ = R._kept(np.arange(7), q, np.arange(a, a + 100), v[a : a + 100], [(0,)] * 100, 3, False, least)
        for x, y in zip(i.tolist(), j.tolist()):
            seen[x].add(a + y)
    assert all(set(np.argsort(-s)[:3].tolist()) <= got for s, got in zip(q @ v.T, seen)) and sum(map(len, seen)) < 7 * 30


def test_containment(spark, monkeypatch):
    import random

    draw = random.Random(1)
    texts = ["".join(draw.choice("ab é𝒳") for _ in range(draw.randint(0, 300))) for _ in range(60)] + [None, ""]
    passages = [t[i : i + n] for t in texts[:40] if t for i, n in ((3, 5), (10, 24), (20, 25), (0, 90), (7, 1))] + [None, "", "zzz", "ab" * 60, "a", "a"]
    monkeypatch.setattr(R, "LOOKED_UP", 400)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").withColumn("item", F.lit(1))
    found = R.containment(spark.createDataFrame(list(enumerate(passages)), "item long, text string"), docs, item="item")
    assert {r["item"]: r["n"] for r in found.collect()} == {i: sum(bool(p) and p in t for t in texts if t) for i, p in enumerate(passages)}
    monkeypatch.setattr(R, "PIECE", 50)
    assert sorted(map(tuple, R.containment(spark.createDataFrame([(1, None)], "item_id long, text string"), docs).collect())) == [(1, 0)]
    assert R.shingle_hashes(b"abcabc", 3)[0] == R.shingle_hashes(b"abcabc", 3)[3] and len(R.shingle_hashes(b"ab", 3)) == 0
