"""Queries of the scans, lookups, prompts and write-backs between the stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import encoder as E
from ragloom.operators import html as H
from ragloom.operators import qa as Q
from ragloom.operators import retrieval as R
from ragloom.operators import serving as V
from ragloom.operators import sync as S
from ragloom.plans.registry import query
from ragloom.plans.search import _PAIRS, _vectors
from ragloom.sources import tables
from ragloom.sources.tables import table

_CONTENT = """
c AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'file' ELSE 'url' END AS type, CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS chunking,
             CASE WHEN page_id % 3 <> 0 THEN html WHEN page_id % 2 = 0 THEN url || '.PDF' ELSE url || '.docx' END AS paragraph FROM pages)"""


def _content(spark, d):
    """Pages as the content table: some are files, whose paragraph is their path, some were chunked."""
    p, i = table(spark, d, "pages"), F.col("page_id")
    path = F.concat("url", F.when(i % 2 == 0, ".PDF").otherwise(".docx"))
    return p.select("page_id", "url", F.when(i % 3 == 0, "file").otherwise("url").alias("type"), F.when(i % 4 == 1, 1).otherwise(0).alias("chunking"), F.when(i % 3 != 0, F.col("html")).otherwise(path).alias("paragraph"))


@query(f"""
WITH {_CONTENT} SELECT page_id, 'page' AS work FROM c WHERE type = 'url' AND chunking = 0 AND contains(paragraph, '<article>')
UNION ALL SELECT page_id, 'pdf' FROM c WHERE type = 'file' AND chunking = 0 AND lower(paragraph) LIKE '%.pdf'
UNION ALL SELECT page_id, 'docx' FROM c WHERE type = 'file' AND chunking = 0 AND lower(paragraph) LIKE '%.docx'""")
def unchunked_work(spark, d):
    rows = _content(spark, d)
    found = tables.unchunked_pages(rows, "<article>").select("page_id", F.lit("page").alias("work"))
    for suffix in ("pdf", "docx"):
        found = found.unionByName(tables.unchunked_files(rows, f".{suffix}").select("page_id", F.lit(suffix).alias("work")))
    return found


@query(f"""
WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM pairs)
SELECT query, id AS position, CASE WHEN id % 7 <> 0 THEN 1000 + id END AS id, round(1 - score, 6) AS distance FROM r WHERE rank <= 5""")
def position_lookup(spark, d):
    """The nearest positions of an index with their distances, and the ids that a map has for them; unknown positions have none."""
    queries, vectors = _vectors(spark, d)
    names = table(spark, d, "embeddings").where("vec_id % 7 <> 0").select(F.col("vec_id").alias("position"), (F.col("vec_id") + 1000).alias("id"))
    hits = R.top_k_blocks(queries, vectors, 5, skip_self=True).withColumnRenamed("id", "position")
    return R.positions_named(hits, names).select("query", "position", "id", F.round(1 - F.col("score"), 6).alias("distance"))


@query("""
WITH p AS (SELECT q.vec_id AS query, v.vec_id AS id, v.vec_id % 3 AS field, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query, field ORDER BY score DESC, id) AS rank FROM p),
l AS (SELECT query, field, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM r WHERE rank <= 5 GROUP BY query, field)
SELECT query, string_agg(field || ': ' || ids, ' | ' ORDER BY field) AS found FROM l GROUP BY query""")
def search_by_field(spark, d):
    queries, vectors = _vectors(spark, d, (F.col("vec_id") % 3).alias("field"))
    found = V.search_fields(queries, vectors)
    return found.select("query", T.pairs_text(F.transform_values("found", lambda _, ids: F.array_join(F.transform(ids, lambda i: i.cast("string")), ","))).alias("found"))


@query(rf"""
SELECT p_partkey, trim(regexp_replace(lower(concat_ws(' ', nullif(trim(p_brand), ''), CASE WHEN p_size % 2 = 0 THEN nullif(trim(p_type), '') END)), '{T.SPACE}+', ' ', 'g')) AS header FROM part""")
def flat_headers(spark, d):
    """Headers of two levels, of which the second is unnamed for odd sizes."""
    second = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit("Unnamed: "), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", T.flat_header(F.array("p_brand", F.lit(" "), second)).alias("header"))


@query("""
WITH w AS (SELECT conv_id, turn, text, regexp_extract(text, '^[^ ]+', 0) AS part FROM conversations)
SELECT conv_id, turn, md5('generate question: ' || CASE WHEN part <> '' THEN '<hl>' || part || '<hl>' || substr(text, length(part) + 1) ELSE text END) AS prompt FROM w""")
def highlight_prompts(spark, d):
    rows = table(spark, d, "conversations").withColumn("part", F.regexp_extract("text", "^[^ ]+", 0))
    return rows.select("conv_id", "turn", F.md5(Q.highlight_prompt(F.col("text"), F.col("part")).cast("binary")).alias("prompt"))


@query("""
WITH q AS (SELECT page_id, url, 'What is ' || page_id || '?' AS ask FROM pages)
SELECT page_id, unnest(['pair', 'judge', 'link answer', 'link question', 'topics', 'hello']) AS kind,
  unnest(['Write one question and its answer about the passage.', 'Mark the answer from 0 to 10.', url, 'Write one question that the page at the link answers.', ask, 'Hello']) AS said, 'site:example.com ' || ask AS search FROM q""")
def prompts(spark, d):
    """A request of each kind to the offline model, which says the first line of the last message, and a search within a site."""
    rows = table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("What is "), F.col("page_id").cast("string"), F.lit("?")).alias("ask"))
    told = F.lit("Write one question and its answer about the passage.")
    made = {
        "pair": Q.question_messages(F.concat(told, F.lit("\n"), "url")),
        "judge": Q.judge_messages(F.col("url"), F.col("ask"), F.lit("Mark the answer from 0 to 10.")),
        "link answer": Q.link_answer_messages(F.col("url"), F.col("ask")),
        "link question": Q.link_question_messages(F.col("url")),
        "topics": Q.topic_messages(F.col("ask")),
        "hello": Q.connectivity_messages(),
    }
    each = rows.select("page_id", "ask", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), m.alias("messages")) for k, m in made.items()))).alias("x"))
    said = Q.asked(each.select("page_id", "ask", "x.kind", "x.messages"), F.col("messages"), "said")
    return said.select("page_id", "kind", "said", Q.site_query(F.col("ask"), "example.com").alias("search"))


@query("""
WITH u AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)
SELECT url, CAST(CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS INT) AS content, CAST(CASE WHEN page_id % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS stored FROM u""")
def contents_stored(spark, d):
    """Fetched contents go in once, whatever is fetched again, and set the flags of their urls."""
    first = table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    urls = first.select("url", F.lit(0).alias("content"))
    content = first.join(table(spark, d, "pages").select("page_id", "html"), "page_id").select("page_id", "url", F.col("html").alias("paragraph"))
    have, new = content.where("page_id % 5 = 1").drop("page_id"), content.where("page_id % 5 <> 0").drop("page_id")
    both, flagged = V.stored_contents(have, urls, new)
    return flagged.join(both.groupBy("url").agg(F.count(F.lit(1)).alias("n")), "url", "left").select("url", "content", F.coalesce("n", F.lit(0)).alias("stored"))


_SCORES = ("bleu", "rouge", "bertscore", "cosine", "recall_at_k", "map_at_k")


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE 'old' END AS actual_answer, CASE WHEN turn % 2 = 0 THEN role ELSE 'old' END AS actual_context, """ + ", ".join(f"CASE WHEN turn % 2 = 0 THEN round(length(text) / {k + 2}.0::DOUBLE, 4) ELSE -1 END AS {c}" for k, c in enumerate(_SCORES)) + " FROM conversations")
def scores_written_back(spark, d):
    """All eight result columns of the evaluated rows; the others keep what they had."""
    rows = table(spark, d, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    held = rows.select("id", "conv_id", "turn", F.lit("old").alias("actual_answer"), F.lit("old").alias("actual_context"), *(F.lit(-1.0).alias(c) for c in _SCORES))
    new = rows.where("turn % 2 = 0").select("id", F.col("text").alias("actual_answer"), F.col("role").alias("actual_context"), *(F.round(F.length("text") / F.lit(float(k + 2)), 4).alias(c) for k, c in enumerate(_SCORES)))
    return S.written_back(held, new, "id", ["actual_answer", "actual_context", *_SCORES]).drop("id")


@query(None)
def contents_appended(spark, d):
    """Titles and texts of the pages that the stored contents lack, after them; a repeated run adds nothing."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id_content"), "html")
    stored = H.contents(pages.where("id_content % 2 = 0"))
    return S.appended_new(stored, H.contents(pages), "id_content")


@query(None)
def encoder_neighbours(spark, d):
    """The five nearest documents of every hundredth one by the encoder that the documents teach, and whether they are of its language."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    vectors = E.embedded(docs, "doc_id")
    hits = R.top_k_blocks(vectors.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec")), vectors, 5, skip_self=True)
    kinds = docs.select(F.col("doc_id").alias("id"), "lang")
    both = hits.join(kinds, "id").join(kinds.toDF("query", "own"), "query")
    return both.select("query", "id", "rank", F.round("score", 4).alias("score"), F.col("lang").eqNullSafe(F.col("own")).alias("same_lang"))
