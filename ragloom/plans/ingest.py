"""Queries over declared tables, nested sitemaps, scanned addresses and segmented words."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions import links as L
from ragloom.functions.text import SPACE, nonblank, sentences
from ragloom.operators import chunking as K
from ragloom.operators import segmentation as S
from ragloom.operators.declared import Declared
from ragloom.plans.registry import query
from ragloom.sources import sitemaps
from ragloom.sources import tables
from ragloom.sources.tables import table

_ORDERS = Declared(
    T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType(), False), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderdate", T.TimestampType()), T.StructField("o_orderpriority", T.StringType())]),
    key=["o_orderkey"],
    defaults={"o_orderpriority": "'5-LOW'"},
    checks={"price is positive": "o_totalprice > 0", "status of a known day": "o_orderdate < timestamp '2200-01-01'"},
    first="o_orderdate",
)

_BREACHED = """
s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, o_orderdate,
             CASE WHEN o_orderkey % 7 = 0 THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority FROM orders
      UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1, o_orderdate + INTERVAL 1 DAY, 'again' FROM orders WHERE o_orderkey % 50 = 0),
b AS (SELECT *, list_filter([CASE WHEN o_custkey IS NULL THEN 'o_custkey is missing' END, CASE WHEN NOT o_totalprice > 0 THEN 'price is positive' END], lambda x: x IS NOT NULL) AS found FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, len(found) = 0 ORDER BY o_orderdate) AS rank FROM b),
j AS (SELECT *, CASE WHEN len(found) = 0 AND rank > 1 THEN ['key'] ELSE found END AS breaches FROM k)"""


def _breached(spark, d):
    """Orders with breaches of each kind: customers and priorities that are missing, negative prices, and keys that come again."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    made = rows.select(key, F.when(key % 101 != 0, F.col("o_custkey")).alias("o_custkey"), F.when(key % 97 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate", F.when(key % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    again = rows.where(key % 50 == 0).select(key, "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("o_orderdate"), F.lit("again").alias("o_orderpriority"))
    return made.unionByName(again)


@query(f"WITH {_BREACHED} SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price, o_orderpriority, array_to_string(breaches, '; ') AS breaches FROM j")
def declared_rows(spark, d):
    out = _ORDERS.judged(_breached(spark, d))
    return out.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"), "o_orderpriority", F.array_join("breaches", "; ").alias("breaches"))


@query(f"""
WITH {_BREACHED}, r AS (SELECT unnest(breaches) AS rule FROM j)
SELECT x.rule, CAST(count(r.rule) AS BIGINT) AS n FROM (SELECT unnest(['o_custkey is missing', 'o_orderkey is missing', 'price is positive', 'status of a known day', 'key']) AS rule) x LEFT JOIN r ON r.rule = x.rule GROUP BY x.rule""")
def declared_report(spark, d):
    return _ORDERS.report(_breached(spark, d))


@query("""
WITH p AS (SELECT url, page_id % 2 = 0 AS known, 'https://' || regexp_extract(url, '://([^/]+)', 1) || '/map-' || (page_id // 40) || '.xml' AS sitemap FROM pages)
SELECT sitemap, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN k.url IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS new
FROM p LEFT JOIN (SELECT DISTINCT url FROM p WHERE known) k USING (url) GROUP BY ROLLUP (sitemap)""")
def sitemap_tree(spark, d):
    """The pages as maps of a site each, under an index for each site, under one index; read back from that one, with the counts of new addresses."""
    pages = table(spark, d, "pages").select("page_id", "url", F.parse_url("url", F.lit("HOST")).alias("host"))
    mark = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    listed = lambda root, tag, c: F.concat(F.lit(f'<?xml version="1.0"?><{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit(f"<{tag}><loc> "), mark(c), F.lit(f" </loc></{tag}>")))), ""), F.lit(f"</{root}>"))
    leaf = F.concat(F.lit("https://"), "host", F.lit("/map-"), F.floor(F.col("page_id") / 40).cast("string"), F.lit(".xml"))
    site = F.concat(F.lit("https://"), "host", F.lit("/index.xml"))
    leaves = pages.groupBy("host", leaf.alias("loc")).agg(listed("urlset", "url", F.col("url")).alias("xml"))
    sites = leaves.groupBy(site.alias("loc")).agg(listed("sitemapindex", "sitemap", F.col("loc")).alias("xml"))
    root = sites.groupBy(F.lit("root").alias("loc")).agg(listed("sitemapindex", "sitemap", F.col("loc")).alias("xml"))
    maps = leaves.select("loc", "xml").unionByName(sites).unionByName(root)
    return tables.sitemap_counts(sitemaps.reached(maps, "root"), pages.where("page_id % 2 = 0").select("url"))


@query(r"""
SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1))) AS link FROM pages""")
def scanned_links(spark, d):
    """The addresses of each page, by the scanner of tags."""
    return table(spark, d, "pages").select("page_id", F.explode(L.page_links(F.col("html"))).alias("link"))


@query(rf"""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_\s]+|\n+')) AS part, generate_subscripts(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_\s]+|\n+'), 1) AS i FROM documents),
w AS (SELECT list_filter(regexp_split_to_array(part, '{SPACE}+'), lambda w: w <> '') AS w FROM s),
r AS (SELECT w, k FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
g AS (SELECT k, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS words FROM r),
c AS (SELECT words, k, count(*)::DOUBLE AS n FROM g GROUP BY ALL),
t AS (SELECT sum(n) AS total FROM c WHERE k = 1),
l AS (SELECT words, k, n, string_split(words, ' ') AS p, unnest(range(1, k)) AS j FROM c WHERE k > 1 AND n >= 4),
m AS (SELECT l.*, array_to_string(p[1 : j], ' ') AS a, array_to_string(p[j + 1 : k], ' ') AS b FROM l),
e AS (SELECT m.words, m.k, m.n, min(ln(m.n * total / (x.n * y.n)) / -ln(m.n / total)) AS bound FROM m JOIN c x ON x.words = a JOIN c y ON y.words = b, t GROUP BY ALL)
SELECT words, CAST(k AS INT) AS size, CAST(n AS BIGINT) AS n, round(bound, 6) AS bound FROM e WHERE bound >= 0.35""")
def lexicon_entries(spark, d):
    """Words of several syllables that the documents teach."""
    return S.entries(table(spark, d, "documents")).select("words", "size", "n", F.round("bound", 6).alias("bound"))


@query(None)
def segmented_chunks(spark, d):
    """Chunks of 256 words with overlap of sentences whose words were joined by the learnt lexicon; a plain model in the tests gives the same."""
    docs = table(spark, d, "documents")
    parts = docs.select("doc_id", nonblank(sentences(F.col("text"))).alias("sentences"))
    return K.overlapping(parts, "sentences", line=S.learnt(docs).line).drop("sentences")
