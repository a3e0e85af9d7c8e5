"""Queries over pages and documents: extraction, cleaning, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import borders as B
from ragloom.operators import chunking as K
from ragloom.operators import html as H
from ragloom.operators import qa as Q
from ragloom.operators import retrieval as R
from ragloom.plans.registry import query
from ragloom.sources.tables import table

_S = T.SPACE
_TOK = rf"list_filter(regexp_split_to_array(text, '{_S}+'), lambda w: w <> '')"


@query("SELECT page_id FROM pages WHERE contains(html, '<article')")
def contains_article(spark, d):
    return table(spark, d, "pages").where(F.col("html").contains("<article")).select("page_id")


@query("SELECT page_id, url FROM pages WHERE lower(url) LIKE '%1'")
def suffix_lower(spark, d):
    return table(spark, d, "pages").select("page_id", "url").where(F.lower("url").endswith("1"))


@query("SELECT page_id FROM pages WHERE url LIKE 'https://%' AND trim(html) <> ''")
def prefix_and_nonblank(spark, d):
    return table(spark, d, "pages").where(F.col("url").startswith("https://") & (F.trim("html") != "")).select("page_id")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE strlen(text) > 5000")
def long_passages_bytes(spark, d):
    return table(spark, d, "documents").where(F.octet_length("text") > 5000).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 60")
def deterministic_sample(spark, d):
    return Q.sampled(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 60)


_LINKS = "list_distinct(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1))"


@query(f"SELECT page_id, unnest({_LINKS}) AS link FROM pages")
def link_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("link"))


@query(f"""
SELECT page_id, CASE WHEN starts_with(link, 'http') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link
       WHEN starts_with(link, '/') THEN scheme || '://' || host || link
       ELSE CASE WHEN ends_with(folder, '/') THEN folder ELSE folder || '/' END || link END AS target
FROM (SELECT page_id, unnest({_LINKS}) AS link, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) AS scheme,
             regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host,
             regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)', 1) AS folder FROM pages)""")
def link_resolve(spark, d):
    found = table(spark, d, "pages").select("page_id", "url", F.explode(T.links(F.col("html"))).alias("link"))
    return found.select("page_id", T.resolved(F.col("url"), F.col("link")).alias("target"))


@query(r"""
SELECT page_id, CASE WHEN length(n) + 4 > 40 THEN right(n, 36) ELSE n END || '.pdf' AS file FROM (SELECT page_id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS n FROM pages)""")
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_filename(F.col("url"), F.lit(".pdf"), 40).alias("file"))


@query("""
SELECT page_id, CASE page_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 3 THEN '.gif' WHEN 4 THEN '.zip' WHEN 5 THEN '.doc' WHEN 6 THEN '.docx' ELSE '' END AS ext FROM pages""")
def mime_ext(spark, d):
    known = ("application/pdf", "image/jpeg", "image/png", "image/gif", "application/zip", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/pdf; charset=utf-8", "text/csv")
    kind = F.element_at(F.array(*map(F.lit, known)), (F.col("page_id") % 9 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", T.extension(kind).alias("ext"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g')) AS digest FROM pages")
def strip_script_style(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.without_scripts(F.col("html")).cast("binary")).alias("digest"))


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '{_S}+', ' ', 'g')) AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


@query(rf"""
WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '^[•\-]{_S}*', ''), '{_S}+', ' ', 'g')) AS t FROM documents),
c AS (SELECT doc_id, unnest(range(1, length(t) + 1)) AS i, t FROM s),
k AS (SELECT doc_id, i, t[i] AS x, lower(t[i]) AS y FROM c),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, y ORDER BY i) AS isle FROM k),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, y, isle) AS run, row_number() OVER (PARTITION BY doc_id, y, isle ORDER BY i) AS nth FROM g)
SELECT s.doc_id, md5(coalesce(o, '')) AS digest FROM s LEFT JOIN
  (SELECT doc_id, string_agg(x, '' ORDER BY i) AS o FROM n WHERE run < 5 OR nth = 1 GROUP BY doc_id) USING (doc_id)""")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, i AS chunk_no, array_to_string(list_slice(w, i * 225 + 1, i * 225 + 250), ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE CAST(greatest(ceil((len(w) - 250) / 225.0), 0) AS INT) + 1 END)) AS i FROM (SELECT doc_id, {_TOK} AS w FROM documents))")
def token_windows(spark, d):
    out = K.token_windows(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


@query(f"SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 250 THEN 1 ELSE ceil((len(w) - 250) / 225.0) + 1 END AS BIGINT) AS n FROM (SELECT doc_id, {_TOK} AS w FROM documents)")
def windows_per_doc(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(K.window_starts(F.size(T.tokens(F.col("text"))))).cast("long").alias("n"))


@query(rf"SELECT doc_id, CAST(len(p) AS BIGINT) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?;–]){_S}+', '\1' || chr(9246), 'g'), '\n+', chr(9246), 'g'), chr(9246)) AS p FROM documents)")
def sentence_split(spark, d):
    parts = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(w) + 2 AS BIGINT) AS n, array_to_string(list_slice(w, 1, 249), ' ') AS head, CASE WHEN length(text) > 113 THEN left(text, 110) || '…' ELSE text END AS preview FROM (SELECT doc_id, text, {_TOK} AS w FROM documents)")
def truncate_preview(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.token_length(text).cast("long").alias("n"), T.truncated(text).alias("head"), T.preview(text).alias("preview"))


_STOP = "['là', 'có', 'và', 'của', 'cho', 'trên', 'trong', 'với', 'một', 'các', 'những', 'rằng', 'vì', 'nên', 'như', 'đã', 'sẽ', 'được', 'từ', 'để', 'khi', 'the', 'of', 'de']"


@query(f"SELECT doc_id, array_to_string(list_filter({_TOK}, lambda w: NOT list_contains({_STOP}, lower(w))), ' ') AS kept FROM documents")
def stopwords_removed(spark, d):
    """The default words, and some of the table's languages."""
    return table(spark, d, "documents").select("doc_id", T.without_stopwords(F.col("text"), (*T.STOPWORDS, "the", "of", "de")).alias("kept"))


@query("SELECT item_id, CAST(count(doc_id) AS BIGINT) AS n FROM benchmark LEFT JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id")
def passage_containment(spark, d):
    return R.containment(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query("""
SELECT conv_id, CAST(sec AS BIGINT) AS section, coalesce(max(CASE WHEN role = 'user' THEN text END), '[Intro]') AS heading,
       string_agg(CASE WHEN role <> 'user' THEN text END, chr(10) ORDER BY turn) AS body
FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS sec FROM conversations)
GROUP BY conv_id, sec HAVING count(CASE WHEN role <> 'user' THEN 1 END) > 0""")
def heading_sections(spark, d):
    nodes = table(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("role") == "user").cast("int").alias("is_heading"), F.lit(None).cast("string").alias("title"))
    return K.sections(nodes, "conv_id", "turn")


@query(None)
def html_sections(spark, d):
    """Sections of the pages' articles; a plain model in the tests gives the same."""
    return K.sections(H.nodes(table(spark, d, "pages").select("page_id", "html")), "page_id", apart=" ")


@query(None)
def html_contents(spark, d):
    return H.contents(table(spark, d, "pages").select("page_id", "html"))


@query(None)
def sentence_pack(spark, d):
    return K.packed_sentences(table(spark, d, "documents").select("doc_id", "text")).drop("text")


@query(None)
def semantic_parts(spark, d):
    return K.semantic_parts_counted(table(spark, d, "documents").select("doc_id", "text"), Q.hashed_places, limit=None)


_TYPE = rf"""CASE WHEN regexp_matches(base, '^[-+]?[.,]?[0-9][0-9.,:%/-]*$') THEN '##' ELSE base END"""
_TIED = lambda a, b, ab: "-2 * (" + " ".join(f"{sign} CASE WHEN ({q}) <= 0 OR ({q}) >= 1 THEN 0 ELSE ({k}) * ln({q}) + (({m}) - ({k})) * ln(1 - ({q})) END" for sign, k, m, q in (("+", ab, a, f"{b} / total"), ("+", f"{b} - {ab}", f"total - {a}", f"{b} / total"), ("-", ab, a, f"{ab} / {a}"), ("-", f"{b} - {ab}", f"total - {a}", f"({b} - {ab}) / (total - {a})"))) + ")"
_BORDERS = rf"""
l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n+')) AS line, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) AS i FROM documents),
w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(line, '{_S}+'), lambda w: w <> '') AS w FROM l),
e AS (SELECT doc_id, i, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
b AS (SELECT *, regexp_replace(regexp_replace(word, '^["''(\[{{«“‘„]+', ''), '["'')\]}}»”’]+$', '') AS body FROM e),
c AS (SELECT *, lower(regexp_replace(body, '[.!?…,;:–]+$', '')) AS base, CASE WHEN regexp_matches(body, '(\.\.|…)$') THEN 'e' WHEN ends_with(body, '.') THEN '.' WHEN regexp_matches(body, '[!?]$') THEN 'b' ELSE '' END AS stop,
      CASE WHEN regexp_matches(body, '^\p{{Lu}}') THEN 'U' WHEN regexp_matches(body, '^\p{{Ll}}') THEN 'l' ELSE '' END AS kind FROM b),
t AS (SELECT doc_id, i, j, {_TYPE} AS type, stop, kind FROM c),
q AS (SELECT coalesce(lag(CASE WHEN stop = '.' THEN type ELSE '' END) OVER o, '') AS key1, coalesce(lag(stop) OVER o, '^') AS stop1, type, stop, kind FROM t WINDOW o AS (PARTITION BY doc_id, i ORDER BY j)),
p AS (SELECT * FROM q WHERE type <> ''),
n AS (SELECT count(*)::DOUBLE AS total, count(*) FILTER (stop = '.') / count(*)::DOUBLE AS share FROM p),
y AS (SELECT type, count(*)::DOUBLE AS n_type, count(*) FILTER (stop = '.')::DOUBLE AS n_with FROM p GROUP BY type),
z AS (SELECT *, len(type) - len(replace(type, '.', '')) AS inn, len(replace(type, '.', '')) AS letters FROM y, n WHERE n_with > 0 AND type <> '##' AND regexp_matches(type, '\p{{L}}')),
abbr AS (SELECT * FROM (SELECT type, -2 * (n_with * ln(share + 1e-8) + (n_type - n_with) * ln(1 - share + 1e-8) - n_with * ln(0.99::DOUBLE) - (n_type - n_with) * ln(0.01::DOUBLE)) * exp(-letters) * (inn + 1) * exp(-(n_type - n_with) * ln(letters)) AS score FROM z) WHERE score >= 0.3),
f AS (SELECT p.*, abbr.type IS NOT NULL AS short, stop1 = 'b' OR (stop1 = '.' AND abbr.type IS NULL) AS ends FROM p LEFT JOIN abbr ON key1 = abbr.type),
s1 AS (SELECT type, count(*)::DOUBLE AS n_start FROM f WHERE ends AND regexp_matches(type, '^\p{{L}}') GROUP BY type),
s2 AS (SELECT * FROM s1 JOIN y USING (type), n, (SELECT count(*)::DOUBLE AS ended FROM f WHERE ends)),
starters AS (SELECT * FROM (SELECT type, {_TIED("ended", "n_type", "n_start")} AS score FROM s2 WHERE total / ended > n_type / n_start) WHERE score >= 30),
k1 AS (SELECT key1 AS a, type AS b, count(*)::DOUBLE AS n_both FROM f WHERE stop1 = '.' AND (short OR key1 = '##' OR regexp_matches(key1, '^\p{{L}}$')) AND regexp_matches(type, '^\p{{L}}') AND type NOT IN (SELECT type FROM starters) GROUP BY ALL),
k2 AS (SELECT a, b, n_both, ya.n_type AS n_a, yb.n_type AS n_b FROM k1 JOIN y ya ON ya.type = a JOIN y yb ON yb.type = b),
coll AS (SELECT * FROM (SELECT a, b, {_TIED("n_a", "n_b", "n_both")} AS score FROM k2, n WHERE total / n_a > n_b / n_both) WHERE score >= 7.88)"""


@query(f"""
WITH {_BORDERS}
SELECT 'abbreviation' AS kind, type AS a, NULL AS b, round(score, 4) AS score FROM abbr UNION ALL SELECT 'starter', type, NULL, round(score, 4) FROM starters
UNION ALL SELECT 'collocation', a, b, round(score, 4) FROM coll""")
def sentence_statistics(spark, d):
    """What the documents teach of sentence borders."""
    found = B.learnt(table(spark, d, "documents"))
    score = F.round("score", 4).alias("score")
    none = F.lit(None).cast("string").alias("b")
    out = found.abbreviations.select(F.lit("abbreviation").alias("kind"), F.col("type").alias("a"), none, score)
    return out.unionByName(found.starters.select(F.lit("starter").alias("kind"), F.col("type").alias("a"), none, score)).unionByName(found.collocations.select(F.lit("collocation").alias("kind"), "a", "b", score))


@query(None)
def learnt_sentences(spark, d):
    """The documents' sentences by the borders that they teach; a plain model in the tests gives the same."""
    docs = table(spark, d, "documents")
    out = B.sentences(docs, B.learnt(docs))
    return out.select("doc_id", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences", "|").cast("binary")).alias("digest"))


@query(None)
def three_tier_chunks(spark, d):
    """Chunks of learnt sentences, then of sentences by marks, then windows."""
    docs = table(spark, d, "documents")
    return K.packed_sentences_learnt(B.sentences(docs, B.learnt(docs)))
