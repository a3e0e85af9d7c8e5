"""Steps whose cost must not grow faster than the input: bounded batches, and counts of runs made once."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest import SF, rows
from ragloom.operators import borders, chunking, encoder, lasting, qa, retrieval, segmentation
from ragloom.operators.borders import _STOP
from ragloom.plans import registry


def test_runs_are_counted_from_the_longest(spark):
    texts = ["A b c a b, a b\n\nb c", "", None, "a", "Ha ha ha ha ha"]
    docs, plain = spark.createDataFrame([(t,) for t in texts], "text string"), Counter()
    for part in ["a b c a b", "a b", "b c", "a", "ha ha ha ha ha"]:
        w = part.split()
        plain.update((" ".join(w[i : i + k]), k) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    counts = segmentation.run_counts(docs)
    assert {(r["words"], r["size"]): r["n"] for r in counts.collect()} == plain
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    kept = {(r["words"], r["size"]) for r in segmentation._frequent(docs, least=3).collect()}
    assert kept == {k for k, n in plain.items() if k[1] == 1 or n >= 3}


def test_stops_are_never_missed(spark):
    words = ["a", "a.", "a.)", "“A.”", "...", "…", "a..\"", "(!)", "?»", ".a", "a.b", "'.'", ".,", "!,"]
    rows = borders.shaped(spark.createDataFrame([(w,) for w in words], "w string"), "w", "x_").withColumn("may", F.col("w").rlike(_STOP)).collect()
    assert all(r["may"] for r in rows if r["x_stop"]) and not any(r["may"] for r in rows if r["w"] in ("a", ".a", "a.b", ".,"))


def test_pieces_that_go_on_keep_their_places(spark):
    texts = [(1, "Z. B. geht es.\n\nDr. Haus kam. Er blieb... und ging."), (2, None), (3, " \n "), (None, "Ein Satz. Noch einer."), (4, "x. " * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    same = docs.select("doc_id", "text").where("doc_id = 1")
    got = {r["doc_id"]: r["sentences"] for r in borders.sentences(docs, borders.learnt(docs)).collect()}
    assert got.keys() == {1, 2, 3, 4, None} and got[2] == got[3] == [] and got[None] == ["Ein Satz.", "Noch einer."]
    assert " ".join(got[1]).split() == same.first()["text"].split() and " ".join(got[4]).split() == ["x."] * 3000


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 64 << 20)
        docs = spark.range(40, numPartitions=1).select("id", F.repeat(F.lit("word "), 40_000).alias("text"))
        chunking.packed_sentences(docs)
        assert int(spark.conf.get(key).rstrip("b")) == lasting.BATCH_BYTES

        @F.pandas_udf("long")
        def rows(column):
            return column.str.len() * 0 + len(column)

        assert docs.select(rows("text").alias("n")).agg(F.max("n")).first()[0] <= 20
    finally:
        spark.conf.set(key, before)


def test_texts_are_split_once_for_an_encoder_and_its_vectors(spark, monkeypatch):
    texts = [(1, "Haus haus_2 baum, Ärger!"), (2, None), (3, " "), (4, "ÉTÉ d'été İzmir"), (5, "haus baum haus"), (None, "baum ?")] + [(10 + i, f"wort{i % 7} haus {i}") for i in range(60)]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    seen: Counter = Counter()
    for _, t in texts:
        seen.update(encoder.words(t).keys())
    assert {r["term"]: r["n"] for r in encoder.term_counts(docs).collect()} == seen
    read, split = [], encoder.counted
    monkeypatch.setattr(encoder, "counted", lambda *a: read.append(1) or split(*a))
    found = {r["id"]: r["vec"] for r in encoder.embedded(docs, "id", size=8).collect()}
    assert len(read) == 1
    model = encoder.learnt(docs, size=8)
    wanted = {i: v for i, t in texts if (v := model.vector(t)) is not None}
    assert found.keys() == wanted.keys() and all(np.abs(np.array(found[i]) - v).max() < 1e-6 for i, v in wanted.items())
    assert encoder.embedded(docs.where("id in (2, 3)"), "id").count() == 0


def test_tasks_send_no_more_than_the_best(spark, monkeypatch):
    draw = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(3000, 6)))], "id long, vec array<double>").repartition(2)
    asked = frame.where("id % 30 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    schema, part = "query long, id long, score double", asked.toArrow()
    monkeypatch.setattr(retrieval, "SCORES", 6400)
    assert frame.mapInArrow(retrieval._scanning(part, 5, (), True), schema).count() == 100 * 5 * 2
    monkeypatch.setattr(retrieval, "PAIRS", 300)
    assert frame.mapInArrow(retrieval._scanning(part, 5, (), True), schema).count() >= 100 * 5 * 2
    wanted = rows(retrieval.top_k(asked, frame, 5, skip_self=True))
    assert rows(retrieval.top_k_blocks(asked, frame, 5, skip_self=True)) == rows(retrieval.top_k_blocks(asked, frame, 5, skip_self=True, few=2000)) == wanted


def test_meaning_breaks_without_a_shuffle(spark, monkeypatch):
    draw = np.random.default_rng(6)
    made = [" ".join(" ".join(f"w{x}" for x in draw.integers(0, 30, draw.integers(1, 9))) + ". " for _ in range(n)) for n in (1, 2, 3, 21, 22, 80)]
    texts = [*enumerate([*made, None, "", " \n ", "Ein Satz.\n???\nNoch einer. " + "wort " * 80, "same. " * 40, "a. b. a. b."])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    places = lambda t, size: qa.hashed_places(F.regexp_replace(t, "[?.]", ""), size)
    monkeypatch.setattr(chunking, "AT_ONCE", 7)
    for options in ({}, {"buffer": 0, "limit": None}, {"buffer": 2, "limit": 4, "percentile": 0.5}):
        wanted = chunking.semantic_parts(docs, lambda t: qa._bag(places(t, 64), F.lit(64)), **options)
        found = chunking.semantic_parts_counted(docs, places, **options)
        assert rows(found) == rows(wanted) and found.columns == wanted.columns
    twice = rows(chunking.semantic_parts_counted(docs.union(docs), places))
    assert twice == sorted(2 * rows(chunking.semantic_parts_counted(docs, places)))
    assert "Exchange" not in registry.QUERIES["semantic_parts"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_sentences_to_segment_go_to_python_once(spark, monkeypatch):
    seen, overlapping = [], chunking.overlapping
    monkeypatch.setattr(chunking, "overlapping", lambda *a, **b: seen.append(overlapping(*a, **b)) or seen[-1])
    registry.QUERIES["segmented_chunks"](spark, SF)
    assert seen[0].drop("sentences")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1


def test_texts_are_split_once_for_counts(spark):
    plan = segmentation.run_counts(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # the texts, and their parts


def test_equal_paths_take_fewer_then_longer_words():
    lexicon = segmentation.Lexicon({"a": 0.1, "b": 0.2, "c": 0.3, "a b": 0.3, "b c": 0.5, "a b c": 0.6}, 9.0, 3)
    assert lexicon.words(["a", "b", "c"]) == [["a", "b", "c"]]  # all cost 0.6 but for what floats leave
    two = segmentation.Lexicon({"a": 0.1, "b": 5.0, "c": 0.1, "a b": 0.7, "b c": 0.7}, 9.0, 3)
    assert two.words(["a", "B", "c"]) == [["a", "B"], ["c"]] and two.words(["b", "x"]) == [["b"], ["x"]]
    assert two.line("a, b (c) x-y a") == "a, b (c) x-y a" and two.line("«A b» c") == "«A_b» c"
    assert segmentation.Lexicon({"a": 1.0, "b": 1.0, "a b": 0.1}, 9.0, 1).words(["a", "b"]) == [["a"], ["b"]]
