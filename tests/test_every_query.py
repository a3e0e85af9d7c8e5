"""The searches: every hundredth id is a query, blocks give what pairs give, contexts are whole."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF, rows
from ragloom.operators import retrieval as R
from ragloom.plans import registry


def test_stated_queries_search(spark):
    wanted = {r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect() if r["vec_id"] % 100 == 0}
    for name in ("vector_topk_hydrate", "fused_topk_ids", "recall_mrr"):
        assert {r["query"] for r in registry.QUERIES[name](spark, SF).select("query").collect()} == wanted


def test_blocks_equal_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 37)
    draw = np.random.default_rng(3)
    made = draw.normal(size=(150, 8)).astype("float32")
    made[20:60] = made[20]  # many equal vectors
    frame = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(made)] + [(500, None, 1)], "id long, vec array<float>, kind int")
    asked = frame.where("vec is not null").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    for by in ((), ("kind",)):
        found, wanted = (f(asked, frame.where("vec is not null"), 5, by=by, skip_self=True) for f in (R.top_k_blocks, R.top_k))
        assert rows(found.toPandas()) == rows(wanted.toPandas())


def test_context_is_whole(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    hits = {}
    for r in registry.QUERIES["vector_topk_hydrate"](spark, SF).collect():
        hits.setdefault(r["query"], []).append(r["id"])
    wanted = {q: "\n\n".join(text[i] for i in sorted(ids) if text.get(i)) for q, ids in hits.items()}
    found = {r["query"]: r["n_chars"] for r in registry.QUERIES["context_assembly"](spark, SF).collect()}
    assert found == {q: len(t) for q, t in wanted.items() if t} and max(found.values()) > 5 * 20 + 8
