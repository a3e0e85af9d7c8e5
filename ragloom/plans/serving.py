"""Queries over content types, stored vectors, questions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import chunking as K
from ragloom.operators import qa as Q
from ragloom.operators import serving as V
from ragloom.plans.registry import query
from ragloom.sources.tables import table

_TYPES = ("text/html; charset=utf-8", "application/pdf", "text/html", "image/gif", "application/zip", None)


@query("SELECT page_id, page_id % 6 IN (0, 2) AS is_html FROM pages")
def content_type_branch(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", T.is_html(kind).alias("is_html"))


@query("SELECT n_nationkey, 'name: ' || n_name || ' | region: ' || CAST(n_regionkey AS VARCHAR) AS line FROM nation")
def map_rendered(spark, d):
    pairs = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", T.pairs_text(pairs).alias("line"))


@query("SELECT conv_id, turn, text AS said, strlen(text) > 0 AS asked FROM conversations")
def reply_content(spark, d):
    """A reply's body as JSON, and its content read back from the nested path; a request's body holds its messages."""
    rows = table(spark, d, "conversations")
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    body = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    request = T.request_json("stub", F.array(message))
    return rows.select("conv_id", "turn", T.reply_text(body).alias("said"), (F.octet_length(F.get_json_object(request, "$.messages[0].content")) > 0).alias("asked"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND strlen(text) > 0")
def unvectorised_nonempty(spark, d):
    rows = table(spark, d, "documents").withColumn("vector", (F.col("doc_id") % 3).cast("int"))
    return V.unvectorised(rows, content="text").select("doc_id")


_FIELDS = """
f AS (SELECT page_id AS id, 'url' AS field, url AS text FROM pages UNION ALL SELECT page_id, 'html', html FROM pages
      UNION ALL SELECT page_id, 'title', trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) FROM pages)"""


@query(f"WITH {_FIELDS} SELECT id, field, md5(text) AS digest FROM f WHERE trim(text) <> ''")
def unpivot_fields(spark, d):
    rows = table(spark, d, "pages").withColumn("title", T.page_title(F.col("html")))
    return V.unpivoted(rows, "page_id", ("url", "title", "html")).select("id", "field", F.md5(F.col("text").cast("binary")).alias("digest"))


_LETTERS = "abcdefgh"


def _letters(times: int):
    """An embedding that SQL can state: how often each of some letters occurs, times a factor."""
    return lambda text: F.array(*((times * (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))))).cast("float") for c in _LETTERS))


@query(f"""
WITH {_FIELDS} SELECT id, field, md5(array_to_string([(CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END) * (length(text) - length(replace(text, c, ''))) for c in {list(_LETTERS)}], ',')) AS digest
FROM f WHERE trim(text) <> ''""")
def vectorize_fields(spark, d):
    """Two batches into the stored vector table, the second in place of half of the first; the digest is of all components."""
    import uuid

    from ragloom.operators.lasting import folder

    rows = table(spark, d, "pages").withColumn("title", T.page_title(F.col("html"))).withColumn("vector", F.lit(0))
    path = f"{folder(spark)}/vectors-{uuid.uuid4().hex}"
    V.write_vectors(V.vectorised(rows, "page_id", ("url", "title", "html"), _letters(1), content="html")[0], path)
    V.write_vectors(V.vectorised(rows.where("page_id % 2 = 0"), "page_id", ("url", "title", "html"), _letters(2), content="html")[0], path)
    whole = F.array_join(F.transform("vec", lambda x: x.cast("long").cast("string")), ",")
    return V.read_vectors(spark, path).select("id", "field", F.md5(whole.cast("binary")).alias("digest"))


@query("""
WITH p AS (SELECT q.vec_id AS query, v.vec_id AS id, v.vec_id % 3 AS field, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query, field ORDER BY score DESC, id) AS rank FROM p),
h AS (SELECT DISTINCT query, id FROM r WHERE rank <= 5),
c AS (SELECT query, string_agg(text, chr(10) || chr(10) ORDER BY id) AS context FROM h JOIN documents ON id = doc_id WHERE length(text) > 0 GROUP BY query),
n AS (SELECT query, CAST(count(*) AS INT) AS n_ids FROM h GROUP BY query)
SELECT vec_id AS query, CAST(CASE WHEN n_ids IS NULL THEN 404 ELSE 200 END AS INT) AS status, coalesce(n_ids, 0) AS n_ids,
       CASE WHEN n_ids IS NOT NULL THEN split_part(coalesce(context, '') || chr(10) || chr(10) || 'What is ' || vec_id || '?', chr(10), 1) END AS answer, CAST(NULL AS VARCHAR) AS error
FROM embeddings LEFT JOIN n ON n.query = vec_id LEFT JOIN c ON c.query = vec_id WHERE vec_id % 100 = 0
UNION ALL SELECT -1 - vec_id, CAST(400 AS INT), 0, NULL, NULL FROM embeddings WHERE vec_id % 100 = 0""")
def answer_with_status(spark, d):
    """Every hundredth vector asks; beside each question a blank one is asked."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.concat(F.lit("What is "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"), F.col("embedding").alias("qvec"))
    asked = asked.unionByName(asked.select((-1 - F.col("query")).alias("query"), F.lit(" ").alias("question"), "qvec"))
    vectors = v.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("field"), F.col("embedding").alias("vec"))
    return V.answered(asked, vectors, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query("""
WITH u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
k AS (SELECT text AS question, arg_min(conv_id, struct_pack(a := conv_id, b := turn)) AS answer FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 GROUP BY text)
SELECT u.conv_id, u.turn, k.answer, CAST(CASE WHEN k.question IS NULL THEN 404 ELSE 200 END AS INT) AS status FROM u LEFT JOIN k USING (question)""")
def question_lookup(spark, d):
    said = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    known = said.where("conv_id % 2 = 0").select("question", F.col("conv_id").alias("answer"), F.struct("conv_id", "turn").alias("at"))
    return V.known_answers(said, known, "at").select("conv_id", "turn", "answer", "status")


@query(r"""
WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS title FROM pages)
SELECT p.page_id, coalesce(t.title, '') AS title FROM pages p LEFT JOIN t ON t.page_id = p.page_id - 1""")
def file_titles(spark, d):
    """Each page as a file that the page before it links to."""
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("url"), (F.col("page_id") - 1).cast("string").alias("parents"), F.col("html").alias("paragraph"))
    return V.titled_by_parent(p.select("page_id", "url"), p.select("url", "parents"), p.select("url", "paragraph")).select("page_id", "title")


@query(r"SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{3000}]') THEN 1 ELSE 0 END AS INT) AS chunking FROM documents")
def leaves_with_flags(spark, d):
    docs = table(spark, d, "documents").withColumn("chunking", F.lit(0))
    return V.with_leaves(docs, K.token_windows(docs.select("doc_id", "text")), "doc_id", "chunking").select("doc_id", "chunking")
