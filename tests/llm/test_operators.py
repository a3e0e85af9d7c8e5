"""The training-data operators against brute force, libraries and planted cases, on small tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF, rows
from ragloom.llm import ann, bpe, crf, graph, jaccard, language, licenses, mix, prefixes, quality, queries, substrings
from ragloom.llm.pieces import split_by, split_known
from ragloom.llm.textwords import blocks, bounds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, size string, c0 string"


def hard_texts():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [" ".join(draw.choice(vocabulary) for _ in range(n)) for n in (3, 8, 36, 60, 90, 200)]
    out = [None, "", "   \n\t", "a", "a b c d", "A B\x0bC\x1cd", "x " * 80, "é日本 " * 5]
    for b in base:
        w = b.split()
        out += [b, b.upper(), b + " tail", " ".join(w[: len(w) // 2]) + " gap " + " ".join(w[len(w) // 2 :]), "lead " + b + " " + base[3]]
        for k in range(8):
            v = list(w)
            v[(7 * k) % len(v)] = f"edit{k}"
            out.append(" ".join(v))
    return out + out[:12]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i if i else None, t, None if i % 5 == 0 else f"s{i % 3}", "en", "x", "y") for i, t in enumerate(hard_texts())], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components(texts):
    """Brute force: {row: (set size, least row reachable)}."""
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    sets = []
    for t in low:
        w = WORD.findall(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in label:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_jaccard(spark, hard, none):
    found = jaccard.similar_classes(hard).collect()
    wanted = components(hard_texts())
    assert len(found) == len(wanted)
    # row 0 has a null id and no words: it is alone
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"]} == {i: w for i, w in wanted.items() if i}
    assert jaccard.similar_classes(none).count() == 0
    kept = jaccard.first_of_each(hard).select("doc_id", "c0").collect()
    assert {r["doc_id"] for r in kept if r["doc_id"]} == {w for i, (_, w) in wanted.items() if i}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["label"] for r in found.collect()} == {**dict.fromkeys(range(1, 41), 1), 90: 90, 95: 90, 100: 90}


def without(texts, window=35):
    split = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_passages(hard, none):
    found = substrings.repeated_passages(hard, carry=["doc_id"]).collect()
    wanted = without(hard_texts())
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found if r["doc_id"]} == {i: w for i, w in enumerate(wanted) if i}
    assert all(sum(s["n"] for s in r["spans"]) == r["n_removed"] for r in found)
    assert substrings.repeated_passages(none).count() == 0
    assert substrings.without_passages(hard).columns == hard.columns


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    cases = [mit, "Copyright (c) 2020 Someone\n\n" + mit.replace('"', "“").replace("sublicense", "sub-license").upper(), mit + " more", "Licenced under the Apache Licence, version 2.0", None, "", "!!"]
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    found = {r["doc_id"]: r["license"] for r in licenses.scan(frame).collect()}
    assert found == {0: "MIT", 1: "MIT", 2: None, 3: "Apache-2.0 notice", 4: None, 5: None, 6: None}
    assert licenses.scan(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF)) == rows(duck.sql(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("sql, query", [(mix.SQL, lambda d: mix.mixed(d, carry=["doc_id"]).drop("times")), (quality.SQL, lambda d: quality.judged(d.select("doc_id", "text")).drop("text"))])
def test_hard_equals_sql(hard, none, sql, query):
    con = duckdb.connect()
    con.register("documents", hard.toPandas().astype({"doc_id": "Int64"}))
    assert rows(query(hard).toPandas().astype({"doc_id": "Int64"})) == rows(con.sql(sql).df().astype({"doc_id": "Int64"}))
    assert query(none).count() == 0


def test_mix_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "big" if i % 3 else f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    found = mix.mixed(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 9 and r["target"] <= 2 * r["size"] for r in found)
    assert mix.repeated(docs).count() == mix.mixed(docs).agg(F.sum("times")).first()[0]


def encoded(table, texts):
    encoder, out = bpe.Encoder(table), []
    for row, end, data, offsets in blocks(pa.array(texts, pa.string())):
        ids, at = encoder.block(data, offsets)
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(end - row)]
    return out


@pytest.fixture(scope="module")
def table():
    return bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(table):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.rank, special_tokens={})


CHARS = st.text(st.sampled_from("'slvremdt ab1,\n\t é日́½\x1c 😀"), max_size=60)


@given(st.lists(CHARS, max_size=8))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_library(table, reference, texts):
    found = encoded(table, texts)
    assert found == [reference.encode_ordinary(t) for t in texts]
    assert [table.decode(np.array(i, np.int64)).decode() for i in found] == texts


def test_bpe_long_and_tables(spark, table, reference, hard, none):
    long = ["ab" * 4000, "é" * 3000, " " * 5000 + "x", "word " * 3000]
    assert encoded(table, long) == [reference.encode_ordinary(t) for t in long]
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(hard, path, pattern), path, pattern)
    assert out.columns == [*hard.columns, "ids", "decoded"]
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in out.collect())
    assert bpe.encode(none, path, pattern).count() == 0
    assert sorted(map(str, bpe.round_trip(hard, path, pattern).collect())) == sorted(map(str, out.collect()))
    found = {r["doc_id"]: r for r in queries.round_trip(hard).collect()}
    for i, t in list(enumerate(hard_texts()))[1:]:
        ids = reference.encode_ordinary(t or "")
        assert found[i]["n_tokens"] == len(ids) and found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@given(CHARS)
@settings(max_examples=150, deadline=None)
def test_splitters_agree(table, text):
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    assert split_known(data, offsets).tolist() == split_by(table.pattern, data, offsets)[0].tolist()


@pytest.fixture(scope="module")
def model():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return prefixes.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)


@given(st.lists(st.text(st.sampled_from("the ingaonrs  ▁é日́\n\t😀<>"), max_size=50), max_size=6))
@settings(max_examples=150, deadline=None)
def test_prefix_counts_equal_library(model, texts):
    counter = prefixes.Counter(model[0])
    for row, _, data, offsets in blocks(pa.array(texts, pa.string())):
        assert counter.totals(data, offsets).tolist() == [len(x) for x in model[1].encode(texts)]
        for t, found in zip(texts, counter.prefixes(data, offsets), strict=True):
            assert found.tolist() == [len(model[1].encode(t[:i])) for i in range(1, len(t) + 1)]


def test_token_tables(hard, none, model):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = {r["doc_id"]: r["n_tokens"] for r in prefixes.count_tokens(hard, path).collect()}
    assert all(found[i] == len(model[1].encode(t or "")) for i, t in enumerate(hard_texts()) if i)
    assert prefixes.count_tokens(none, path).count() == 0
    cut = prefixes.prefix_counts(hard, path).withColumn("n", prefixes.longest_prefix("prefix_tokens", 5))
    for r in cut.collect():
        text = r["text"] or ""
        assert r["n"] == max([i for i in range(len(text) + 1) if len(model[1].encode(text[:i])) <= 5])


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(1500, 16)).round(3)
    x[1200:] = x[0]  # a hot vector
    data = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(5000, None, "x"), (5001, [0.0] * 16, "x"), (5002, [float("nan")] * 16, "x"), (5003, [1.0], "x"), (5004, [None] * 16, "x")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, q string")
    found = ann.neighbours(frame, frame.where("vec_id % 20 = 0"), 20).collect()
    by = collections.defaultdict(dict)
    for r in found:
        by[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in range(0, 1500, 20):
        score = (x * x[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        got = [by[q][k][0] for k in range(1, 21)]
        hits += len(set(best) & set(got))
        assert got == sorted(got, key=lambda i: (-score[i], i)) and all(by[q][k][1] == pytest.approx(score[by[q][k][0]]) for k in by[q])
        if q == 0 or q >= 1200:
            assert got == best
    assert hits >= 0.9 * 75 * 20 and set(by) == set(range(0, 1500, 20))
    assert ann.neighbours(frame.limit(0), frame, 20).count() == 0
    few = frame.where("vec_id < 4")
    assert ann.neighbours(few, few, 20).count() == 12


def test_language(spark, hard, none):
    found = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.9
    trained = language.train(["the cat and the dog", "der Hund und die Katze", "das ist gut", "it is good"], ["en", "de", "de", "en"])
    out = {r["doc_id"]: r for r in language.identify(hard, trained).collect()}
    assert out[2]["lang_pred"] == "und" and out[2]["rejected"] and out[2]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[7]["lang_pred"] in ("en", "de")
    assert language.identify(none, trained).count() == 0
    assert language.identify(hard, language.train([], [])).where("not rejected").count() == 0
    assert language.learnt(none).languages == []


def test_marginals_by_enumeration():
    draw = np.random.default_rng(1)
    sizes = [1, 3, 0, 7]
    odds, change = draw.normal(size=sum(sizes)), draw.normal(size=(2, 2))
    first = np.concatenate([[0], np.cumsum(sizes)])
    found = crf.marginals(odds, first, change)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total, one = 0.0, np.zeros(b - a)
        for states in np.ndindex(*[2] * (b - a)):
            s = np.array(states)
            w = np.exp((odds[a:b] * s).sum() + sum(change[x, y] for x, y in zip(s[:-1], s[1:], strict=True))) if len(s) else 1
            total += w
            one += w * s
        assert np.allclose(found[a:b], one / total)
    long = draw.normal(size=1000)
    whole = crf.marginals(long, np.array([0, 1000]), change)
    p, _ = crf._sequences(long[None, :], np.ones((1, 1000), bool), change)
    assert np.allclose(whole, p[0])


def test_toxicity(spark, hard, none):
    draw = random.Random(8)
    text = lambda bad: " ".join([draw.choice(["sun", "tree", "road", "lake", "hill", "bird", "stone"]) + draw.choice(["", "s", "y"]) for _ in range(30)] + ([draw.choice(["grubbo", "snerk"])] if bad else []) + ["end."])
    docs = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(600)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in docs if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, toxic int")
    field = crf.learnt(frame, labels)
    out = {r["doc_id"]: r for r in crf.score(frame, field).collect()}
    assert all((out[i]["score"] >= 0.7) == y for i, _, y in docs)
    assert all(t[s["start"] : s["end"]] in ("grubbo", "snerk") for i, t, y in docs if y for s in out[i]["spans"])
    assert {r["score"] for r in crf.score(hard.where("trim(text) = ''"), field).collect()} == {0.0}
    assert crf.score(none, field).count() == 0
    assert not crf.learnt(none, labels.limit(0)).weights.any()


def test_word_bounds():
    texts = ["", " a  b", "c", "", "d e "]
    (_, _, data, offsets), = blocks(pa.array(texts))
    starts, ends, first = bounds(data, offsets)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"a", b"b", b"c", b"d", b"e"]
    assert first.tolist() == [0, 0, 2, 3, 3, 5]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.where("not round_trip").isEmpty()
    # by brute force: rejected languages, near duplicates, passages, then the mix's own SQL
    kept = corpus_pipeline.identify_language(spark, docs, SF).toPandas().sort_values("doc_id")
    label = components(kept["text"].tolist())
    kept = kept[[label[i][1] == i for i in range(len(kept))]]
    cut = without(kept["text"].tolist())
    kept["text"] = [t if not n else k for t, (_, n, k) in zip(kept["text"], cut, strict=True)]
    documents = kept[[bool(WORD.search(t)) for t in kept["text"]]]
    con = duckdb.connect()
    con.register("documents", documents)
    times = {r[0]: r[1] for r in con.sql(f"select doc_id, taken // size from ({mix.SQL}) where size > 0").fetchall()}
    found = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert found == collections.Counter({(i, t): int(times[i]) for i, t in zip(documents["doc_id"], documents["text"], strict=True) if times[i]})
