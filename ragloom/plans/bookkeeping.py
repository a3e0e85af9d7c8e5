"""Queries over crawl state, synchronisation and relational lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import frontier as C
from ragloom.operators import sync as S
from ragloom.plans.registry import query
from ragloom.sources.tables import sitemap_counts, table


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate = (SELECT min(o_orderdate) FROM orders WHERE o_orderstatus = 'P')")
def frontier_min_scalar(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") != "P").cast("int").alias("crawled"))
    return C.frontier(rows, "crawled", "o_orderdate").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def pending_flag(spark, d):
    rows = table(spark, d, "orders").withColumn("content", F.when(F.col("o_orderstatus") == "O", 0).otherwise(1))
    return C.pending(rows, "content").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-15')")
def incremental_after_watermark(spark, d):
    events = table(spark, d, "events")
    mark = S.watermark(events.where("event_id % 10 = 0 and ts < timestamp'2024-01-15'"), "ts")
    return S.after_watermark(events, mark, "ts").select("event_id", "user_id", "ts")


@query(f"SELECT coalesce(max(ts), TIMESTAMP '{S.EPOCH}') AS watermark FROM events WHERE event_type = 'none such'")
def watermark_default(spark, d):
    return S.watermark(table(spark, d, "events").where("event_type = 'none such'"), "ts")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1 AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def new_rows_anti_join(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    return C.unknown(customer.where("c_custkey % 2 = 1"), customer.where("c_custkey % 3 = 0"), "c_custkey")


@query("""
SELECT o_custkey, o_orderkey FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END, o_orderkey) AS r FROM orders) WHERE r = 1""")
def insert_or_ignore(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return C.inserted_or_ignored(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 <> 0"), "o_custkey", "o_orderkey")


@query("""
SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NOT NULL THEN t.c_name ELSE s.c_name END AS c_name,
       CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal
FROM (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0) t
FULL JOIN (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) s ON t.c_custkey = s.c_custkey""")
def upsert_partial_columns(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = customer.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return S.upserted(customer.where("c_custkey % 3 <> 0"), new, "c_custkey", ["c_custkey", "c_acctbal"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def append_new_keys(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return S.appended_new(customer.where("c_custkey % 2 = 0"), customer.where("c_custkey % 3 = 0"), "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 1 ELSE 0 END AS crawled FROM orders")
def mark_by_key(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("url"), F.lit(0).alias("crawled"))
    done = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("url"))
    return C.marked(orders, done, "url", crawled=1).select("o_orderkey", "crawled")


@query("SELECT n_nationkey, n_name, r_name AS parent FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 0) ON n_regionkey = r_regionkey")
def parent_lookup(spark, d):
    out = S.looked_up(table(spark, d, "nation"), table(spark, d, "region").where("r_regionkey > 0"), "n_regionkey", "r_regionkey", "r_name", "parent")
    return out.select("n_nationkey", "n_name", "parent")


@query("""
SELECT l_orderkey, l_linenumber, c_name AS owner FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""")
def two_hop_parent(spark, d):
    out = S.looked_up(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, d, "orders"), "l_orderkey", "o_orderkey", "o_custkey", "k")
    return S.looked_up(out, table(spark, d, "customer"), "k", "c_custkey", "c_name", "owner").select("l_orderkey", "l_linenumber", "owner")


@query("""
SELECT s_suppkey, coalesce(b, s_acctbal) AS s_acctbal FROM supplier LEFT JOIN (SELECT s_suppkey AS k, round(s_acctbal * 2, 2) AS b FROM supplier WHERE s_suppkey % 4 = 1) ON s_suppkey = k""")
def write_back(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    new = rows.where("s_suppkey % 4 = 1").select("s_suppkey", F.round(F.col("s_acctbal") * 2, 2).alias("s_acctbal"))
    return S.written_back(rows, new, "s_suppkey", ["s_acctbal"])


@query("""
SELECT parse AS sitemap, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN page_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS new
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS parse FROM pages) GROUP BY ROLLUP (parse)""")
def seed_counts_by_host(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    found = pages.select(F.parse_url("url", F.lit("HOST")).alias("sitemap"), F.col("page_id").alias("url"))
    return sitemap_counts(found, pages.where("page_id % 3 = 0").select(F.col("page_id").alias("url")))


@query("SELECT CAST((r - 1) // 500 AS BIGINT) AS batch, CAST(max(r) AS BIGINT) AS done, CAST(any_value(n) AS BIGINT) AS total FROM (SELECT row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) GROUP BY 1")
def batch_progress(spark, d):
    return S.batch_progress(table(spark, d, "documents"), "doc_id")


@query("SELECT page_id, link, CASE WHEN row_number() OVER (PARTITION BY page_id ORDER BY link DESC) = 1 THEN 1 ELSE 0 END AS is_last FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1))) AS link FROM pages)")
def last_link(spark, d):
    found = table(spark, d, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("link"))
    return C.with_last_flag(found, "page_id", "link")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_suppkey % 2 = 0)")
def parents_completed(spark, d):
    links = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    done = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return C.completed(links, done, "l_orderkey", "l_suppkey")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS parent, (o_custkey * 7 + o_orderkey) % 997 AS child FROM orders),
w(url, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT child, depth + 1 FROM w JOIN e ON parent = url WHERE depth < 5)
SELECT CAST(url AS VARCHAR) AS url, min(depth) AS depth FROM w GROUP BY 1""")
def link_spread(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("parent"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 997).cast("string").alias("child")).distinct()
    return C.spread(spark.createDataFrame([("1",)], "url string"), edges).select("url", "depth")


@query("SELECT conv_id, turn, role FROM (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS s FROM conversations) WHERE s IS NULL OR turn < s")
def take_while_null(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") != "assistant", F.col("role")).alias("c0"))
    return S.take_while(rows, "conv_id", "turn", "c0").select("conv_id", "turn", "role")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def valid_types(spark, d):
    return S.split_valid(table(spark, d, "events").select("event_id", "event_type"), F.col("event_type").isin("click", "view"))[0]


@query("SELECT event_id, event_type FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view')")
def quarantined_types(spark, d):
    return S.split_valid(table(spark, d, "events").select("event_id", "event_type"), F.col("event_type").isin("click", "view"))[1]


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def first_seen_batch(spark, d):
    first = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(first).alias("r")).where("r = 1").drop("r")
