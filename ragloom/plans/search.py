"""Queries over vectors, retrieval and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragloom.functions import scoring as S
from ragloom.functions import vectors as V
from ragloom.operators import qa as Q
from ragloom.operators import retrieval as R
from ragloom.plans.registry import query
from ragloom.sources.tables import table

_PAIRS = """
pairs AS (SELECT q.vec_id AS query, v.vec_id AS id, v.label, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"""


def _vectors(spark, d, *by):
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), *by)


@query(f"""
WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM pairs)
SELECT query, id, score, CAST(rank AS INT) AS rank, label FROM r WHERE rank <= 5""")
def vector_topk_hydrate(spark, d):
    queries, vectors = _vectors(spark, d)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return R.hydrated(R.top_k_blocks(queries, vectors, 5, skip_self=True), rows).select("query", "id", "score", "rank", "label")


@query(f"""
WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query, id % 3 ORDER BY score DESC, id) AS rank FROM pairs),
u AS (SELECT DISTINCT query, id FROM r WHERE rank <= 5)
SELECT query, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM u GROUP BY query""")
def fused_topk_ids(spark, d):
    queries, vectors = _vectors(spark, d, (F.col("vec_id") % 3).alias("field"))
    found = R.fused(R.top_k_blocks(queries, vectors, 5, by=("field",), skip_self=True))
    return found.select("query", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""
WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM pairs),
c AS (SELECT query, string_agg(text, chr(10) || chr(10) ORDER BY id) AS context FROM r JOIN documents ON id = doc_id WHERE rank <= 5 AND length(text) > 0 GROUP BY query)
SELECT query, CAST(length(context) AS BIGINT) AS n_chars, sha256(context) AS context_sha256 FROM c""")
def context_assembly(spark, d):
    """Whole contexts; of their width only the length and a digest are returned."""
    queries, vectors = _vectors(spark, d)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    found = R.context(R.top_k_blocks(queries, vectors, 5, skip_self=True), rows)
    return found.select("query", F.length("context").cast("long").alias("n_chars"), F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id ORDER BY n DESC, min(struct_pack(a := ts, b := event_id)) LIMIT 5")
def id_frequency_topk(spark, d):
    return R.most_common(table(spark, d, "events"), "user_id", 5, "ts", "event_id")


@query("SELECT label, CAST(i AS INT) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY ALL")
def mean_pool_label(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("SELECT vec_id, CAST(d AS INT) AS dim, round((embedding[d + 1]::DOUBLE + embedding[d + 17] + embedding[d + 33] + embedding[d + 49]) / 4, 6) AS mean FROM (SELECT vec_id, embedding, unnest(range(0, 8)) AS d FROM embeddings)")
def masked_mean_pool(spark, d):
    """Each vector as eight rows of eight dimensions, of which every other one counts."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i % 2 == 0).cast("int"))
    pooled = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.masked_mean(rows, mask, 8)).alias("dim", "mean"))
    return pooled.select("vec_id", "dim", F.round("mean", 6).alias("mean"))


@query("SELECT vec_id, CAST(i AS INT) AS dim, round(embedding[i + 1]::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 6) AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)")
def l2_normalise(spark, d):
    out = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.normalised(F.col("embedding"))).alias("dim", "x"))
    return out.select("vec_id", "dim", F.round("x", 6).alias("x"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = v.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("w"))
    return v.withColumnRenamed("vec_id", "a").join(b, "a").select("a", "b", F.round(V.cosine(F.col("embedding"), F.col("w")), 6).alias("cosine"))


@query(f"""
WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM pairs),
n AS (SELECT p.query, arg_min(p.id, struct_pack(a := -p.score, b := p.id)) AS relevant FROM pairs p JOIN embeddings q ON q.vec_id = p.query WHERE p.label = q.label GROUP BY p.query)
SELECT n.query, CAST(coalesce(max(CASE WHEN r.id = relevant THEN 1 END), 0) AS INT) AS recall, coalesce(max(CASE WHEN r.id = relevant THEN round(1.0::DOUBLE / rank, 4) END), 0.0::DOUBLE) AS rr
FROM n JOIN r ON r.query = n.query AND rank <= 5 GROUP BY n.query""")
def recall_mrr(spark, d):
    queries, vectors = _vectors(spark, d, "label")
    ranked = R.top_k_blocks(queries, vectors, 5, skip_self=True)
    ids = ranked.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    near = R.top_k_blocks(queries.join(labels, "query").select("query", "qvec"), vectors.withColumnRenamed("label", "field"), 1, by=("field",), skip_self=True)
    near = near.join(labels, "query").where("field = own").select("query", F.col("id").alias("relevant"))
    return ids.join(near, "query").select("query", S.recall_at_k(F.col("ids"), F.col("relevant")).alias("recall"), F.round(S.reciprocal_rank(F.col("ids"), F.col("relevant")), 4).alias("rr"))


@query("""
SELECT conv_id, turn, text AS question, (SELECT arg_min(a.text, a.turn) FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn > u.turn AND a.role = 'assistant') AS answer
FROM conversations u WHERE role = 'user'""")
def dialog_pairs(spark, d):
    return _dialog(spark, d)


def _dialog(spark, d):
    after = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    reply = F.first(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(after)
    return table(spark, d, "conversations").withColumn("answer", reply).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query(None)
def bleu_sentence(spark, d):
    return _dialog(spark, d).select("conv_id", "turn", F.round(S.bleu(F.col("question"), F.col("answer")), 4).alias("bleu"))


@query(None)
def rouge_l(spark, d):
    return _dialog(spark, d).select("conv_id", "turn", F.round(S.rouge_l(F.col("question"), F.col("answer")), 4).alias("rouge_l"))


@query(None)
def answer_evaluation(spark, d):
    rows = _dialog(spark, d).where("answer is not null")
    rows = Q.asked(rows, Q.answer_messages(F.col("answer"), F.col("question")), "said").withColumn("ids", F.array("turn")).withColumn("relevant", F.col("turn"))
    rows = rows.withColumn("v", Q.hashed_embedding(F.col("said"))).withColumn("w", Q.hashed_embedding(F.col("answer")))
    return Q.evaluated(rows, "said", "answer", "ids", "relevant", "v", "w").drop("v", "w", "ids")
