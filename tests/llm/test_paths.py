"""op5's compaction: paths of a graph drawn by hand, stretches along them, and a result that needs them to be right."""

from pyspark.sql import functions as F

from conftest import SF, rows
from ragloom.llm import queries, substrings


def test_paths_and_stretches(spark):
    # one line over two sources, a fork at node 9, and a ring
    edges = [(1, 2, 7, 0), (2, 3, 7, 1), (3, 4, 8, 5), (4, 5, 8, 6), (5, 9, 7, 3), (9, 10, 7, 4), (9, 11, 8, 9), (20, 21, 5, 0), (21, 20, 5, 1)]
    paths = substrings._paths(spark.createDataFrame(edges, "l long, r long, u long, p int"))
    got = {(r["u"], r["p"]): r for r in paths.collect()}
    assert {k: r["n"] for k, r in got.items()} == {(7, 0): 2, (8, 5): 2, (7, 3): 1, (7, 4): 1, (8, 9): 1, (5, 0): 2}
    line = [got[k] for k in ((7, 0), (8, 5), (7, 3))]
    assert len({r["path"] for r in line}) == 1 and [r["at"] for r in line] == [0, 2, 4]
    assert len({got[k]["path"] for k in ((7, 0), (7, 4), (8, 9), (5, 0))}) == 4
    # a source that goes along the whole line by way of three references, and on to one side of the fork
    spans = spark.createDataFrame([(3, 10, 2, 7, 0), (3, 12, 2, 8, 5), (3, 14, 2, 7, 3), (4, 0, 1, 8, 6), (4, 5, 1, 8, 5), (4, 9, 1, 99, 0)], "u long, p int, n int, ru long, rp int")
    found = sorted((r["u"], r["p"], r["n"], r["path"] == line[0]["path"], r["at"]) for r in substrings._along(spans, paths).collect())
    assert found == [(3, 10, 5, True, 0), (3, 15, 1, False, 0), (4, 0, 1, True, 3), (4, 5, 1, True, 2)]


def test_blocks_of_coordinates_join_again(spark):
    n = 3 * substrings.BLOCK + 7
    edges = spark.createDataFrame([(k, k + 1, 1, 100 + k) for k in range(n)], "l long, r long, u long, p int")
    spans = spark.createDataFrame([(2, 5, n, 1, 100)], "u long, p int, n int, ru long, rp int")
    assert [(r["p"], r["n"], r["at"]) for r in substrings._along(spans, substrings._paths(edges)).collect()] == [(5, n, 0)]


def test_the_result_needs_the_paths(spark, duck, monkeypatch):
    true, wanted = substrings._paths, rows(duck.sql(queries.ORACLE_SQL["op5_substring_dedup"]))
    assert rows(queries.op5_substring_dedup(spark, SF)) == wanted
    monkeypatch.setattr(substrings, "_paths", lambda edges: true(edges).where("p % 2 = 0"))
    assert rows(queries.op5_substring_dedup(spark, SF)) != wanted
    monkeypatch.setattr(substrings, "_paths", lambda edges: true(edges).withColumn("n", F.lit(1)))
    assert rows(queries.op5_substring_dedup(spark, SF)) != wanted
