"""The learnt encoder: against a dense decomposition, and its neighbours against those of hashed words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from ragloom.operators import encoder, qa, retrieval


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").repartition(3)


@pytest.fixture(scope="module")
def model(docs):
    return encoder.learnt(docs, terms=3000, size=24)


def dense(model, docs):
    rows = [model.row(r["text"]) for r in docs.collect()]
    out = np.zeros((len(rows), len(model.places)))
    for line, (at, weight) in zip(out, rows):
        line[at] = weight
    return out


def test_decomposition(model, docs):
    a, v = dense(model, docs), model.basis
    assert v.shape == (3000, 24) and np.abs(v.T @ v - np.eye(24)).max() < 1e-9
    exact = np.linalg.svd(a, compute_uv=False)[:24]
    assert np.abs(model.values - exact).max() < 0.02 * exact[0] and np.abs(model.values[:8] - exact[:8]).max() < 1e-3
    residual = np.linalg.norm(a.T @ (a @ v) - v * model.values**2, axis=0) / model.values**2
    assert residual[:8].max() < 0.02 and residual.max() < 0.4


def test_product_and_counts(model, docs):
    a, basis = dense(model, docs), np.random.default_rng(1).normal(size=(3000, 5))
    assert np.abs(encoder.multiplied(encoder.matrix(docs, model), basis) - a.T @ (a @ basis)).max() < 1e-4
    plain = {}
    for r in docs.collect():
        for w in encoder.words(r["text"]):
            plain[w] = plain.get(w, 0) + 1
    assert {r["term"]: r["n"] for r in encoder.term_counts(docs).collect()} == plain


def share_alike(docs, embed, field="lang"):
    vectors = docs.withColumn("vec", embed(F.col("text"))).where("vec is not null").cache()
    asked = vectors.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query"), F.col("vec").alias("qvec"))
    hits = retrieval.top_k_blocks(asked, vectors.select(F.col("doc_id").alias("id"), "vec"), 5, skip_self=True)
    kinds = docs.select(F.col("doc_id").alias("id"), F.col(field).alias("kind"))
    both = hits.join(kinds, "id").join(kinds.select(F.col("id").alias("query"), F.col("kind").alias("own")), "query")
    return both.agg(F.avg((F.col("kind") == F.col("own")).cast("double"))).first()[0]


def test_neighbours_of_one_language(model, docs):
    learnt, hashed = share_alike(docs, model.embed), share_alike(docs, qa.hashed_embedding)
    assert learnt > 0.95 and learnt > hashed, (learnt, hashed)


def test_edges(spark, model):
    texts = [("haus haus baum",), (None,), ("",), ("?! ...",), ("haus",)]
    one = encoder.learnt(spark.createDataFrame(texts, "text string"))
    assert one.basis.shape == (2, 2) and set(one.places) == {"haus", "baum"}
    got = [r[0] for r in spark.createDataFrame(texts, "text string").select(one.embed(F.col("text"))).collect()]
    assert [g is None for g in got] == [False, True, True, True, False] and abs(np.linalg.norm(got[0]) - 1) < 1e-6
    none = encoder.learnt(spark.createDataFrame([], "text string"))
    assert none.vector("haus") is None and none.basis.shape == (0, 0)
    assert abs(np.linalg.norm(model.vector("un le " * 300_000)) - 1) < 1e-6
