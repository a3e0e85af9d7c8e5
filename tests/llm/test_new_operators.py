"""op11 to op13: against brute force over whole tables, planted cases, and edges of the input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from ragloom.llm import importance, lexical, private, queries
from ragloom.llm.tagger import Tagger, padded

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
EDGES = [(1, "Das Haus, das Haus steht am Haus."), (1, "Das Haus, das Haus steht am Haus."), (2, None), (3, ""), (None, "das Haus"), (None, "haus"), (5, "--- !!"), (6, "HAUS " * 200_000), (7, "Éa éA ÉA"), (8, "x")]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table(spark, values=EDGES, columns="doc_id long, text string"):
    return spark.createDataFrame(values, columns)


# op12


def ranked(docs, items, best=20):
    """The contract, row by row."""
    terms = [(i, Counter(WORD.findall(lowered(t)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(c.total() for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in terms:
            m = 75 + (25 * c.total() * n) // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w, r in Counter(WORD.findall(lowered(text))).items() if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


def test_search_edges(spark):
    items = [(1, "Haus das das"), (1, "x"), (2, None), (3, "nirgends"), (None, "éa Éa steht"), (4, "")]
    docs = table(spark).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(3)
    found = lexical.search(docs, table(spark, items, "item_id long, text string"), best=4, window=2)
    # of equal rows any may be ranked first, so ids are compared with their scores
    assert sorted((tuple(r) for r in found.collect()), key=str) == ranked(EDGES, items, 4)
    assert lexical.search(table(spark, []), table(spark, items, "item_id long, text string")).count() == 0
    assert lexical.search(docs, table(spark, [], "item_id long, text string")).count() == 0


def test_search_windows_and_blocks(spark):
    draw = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(60)])
    docs = [(int(i), " ".join(draw.choice(words, draw.integers(1, 40)))) for i in draw.permutation(600)]
    docs += [(1000 + k, docs[0][1]) for k in range(300)]  # copies: ties go by id
    items = [(k, " ".join(draw.choice(words, 6))) for k in range(9)]
    found = lexical.search(table(spark, docs).repartition(3), table(spark, items, "item_id long, text string"), window=100, item_bytes=80)
    assert sorted((tuple(r) for r in found.collect()), key=str) == ranked(docs, items)


def test_long_text_is_not_cut():
    from ragloom.llm.terms import runs

    raw = ("Ab-ça 12 " * 5000).encode()
    assert [w for part in runs(raw, piece=1000) for w in part] == [w.encode() for w in WORD.findall(lowered(raw.decode()))]


# op13


def drawn(docs, target, longest=1, buckets=10000, least=20, percent=10, seed="2024"):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def of(text):
        w = words.findall(lowered(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    mine, theirs = [(i, *of(t)) for i, t in docs], [of(t)[1] for t in target]
    s, t = Counter(b for _, _, f in mine for b in f), Counter(b for f in theirs for b in f)
    out = []
    for i, n, f in mine:
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = gain // len(f) if f else 0
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_importance_edges(spark):
    target = [("Haus das",), (None,), ("",)]
    docs = table(spark).withColumn("rank", F.lit("clash")).withColumn("c0", F.lit(2))
    found = importance.resampled(docs, spark.createDataFrame(target, "text string"), carry=["c0", "rank"], least_words=1, percent=60)
    assert found.columns == ["doc_id", "c0", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.drop("c0").collect()), key=str) == drawn(EDGES, [t for (t,) in target], least=1, percent=60)
    assert importance.resampled(table(spark, []), spark.createDataFrame(target, "text string")).count() == 0
    assert importance.resampled(table(spark), spark.createDataFrame([], "text string")).where("rank is not null").count() == 0


def test_importance_of_longer_runs_and_many_ranges(spark):
    draw = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(300)])
    docs = [(int(i), " ".join(draw.choice(words, draw.integers(0, 60)))) for i in range(400)] + [(7, "w1 " * 30)] * 40  # one id, equal rows
    target = [" ".join(draw.choice(words[:50], 30)) for _ in range(20)]
    found = importance.resampled(table(spark, docs).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), longest=3, buckets=500, percent=50)
    got, wanted = [tuple(r) for r in found.collect()], drawn(docs, target, longest=3, buckets=500, percent=50)
    assert sorted(r[5] for r in got if r[5]) == list(range(1, sum(r[5] is not None for r in wanted) + 1))
    assert sorted(got, key=str) == wanted


# op11

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            double = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1]))
            if (True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else False, 14 <= len(digits) <= 19 and double % 10 == 0, 10 <= len(digits) <= 15)[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1@.0+- ()Z%9é2", max_size=60))
def test_patterns_equal_plain_matches(text):
    assert private.patterned(text) == plain_base(text)


def test_patterns_are_linear():
    for text in ("a" * 300_000, "1" * 300_000 + ".", "+1" + "(" * 300_000, "a@" * 100_000, "1." * 100_000):
        private.patterned(text)


def test_gradient_and_best_path():
    draw = np.random.default_rng(0)
    tagger = Tagger(*(p.astype(float) + draw.normal(size=p.shape) * 0.2 for p in Tagger.fresh(3, units=3).parts))
    lines, tags = [draw.integers(1, 99, n).astype(np.uint8) for n in (5, 2, 4)], [draw.integers(0, 3, n).astype(np.uint8) for n in (5, 2, 4)]
    x, real = padded(lines)
    y, _ = padded(tags)
    _, grads = tagger.likelihood(x, real, y)
    for part, grad in zip(tagger.parts, grads):
        for at in [tuple(draw.integers(0, s) for s in part.shape) for _ in range(5)]:
            was, change = part[at], []
            for step in (1e-3, -1e-3):
                part[at] = was + step
                change.append(tagger.likelihood(x, real, y)[0])
            part[at] = was
            assert abs((change[0] - change[1]) / 2e-3 - grad[at]) < 2e-4
    # the decoded path and its marginals against all paths
    import itertools

    for line, (path, sure) in zip(lines, tagger.decode(lines)):
        x, real = padded([line])
        emit = tagger.emissions(tagger.states(x, real)[0])[:, 0]
        weight = {p: tagger.start[p[0]] + sum(emit[t, k] for t, k in enumerate(p)) + sum(tagger.change[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(3), repeat=len(line))}
        assert tuple(path) == max(weight, key=weight.get)
        total = sum(math.exp(v) for v in weight.values())
        for t, k in enumerate(path):
            assert abs(sum(math.exp(v) for p, v in weight.items() if p[t] == k) / total - sure[t]) < 1e-3


def test_reconciled_is_the_best_choice():
    import itertools

    draw = np.random.default_rng(2)
    for _ in range(40):
        spans = [(float(draw.random()), int(draw.integers(0, 4)), int(a), int(a + draw.integers(1, 8))) for a in draw.integers(0, 20, 7)]
        fixed = [(0, 5, 7)]
        apart = lambda c: all(x[3] <= y[2] or y[3] <= x[2] for x, y in itertools.combinations(c, 2)) and all(s[3] <= 5 or s[2] >= 7 for s in c)
        best = max(sum(s[0] for s in c) for n in range(8) for c in itertools.combinations(spans, n) if apart(c))
        got = private.reconciled(spans, fixed)
        assert apart(got) and abs(sum(s[0] for s in got) - best) < 1e-9


def test_regions_cover_windows_and_borders():
    text = "x" * 500 + "a@b" + "y" * 79 + "1" + "z" * 3000 + "9"
    assert private.regions(text, piece=101) == private.regions(text) == [(461, 623), (3543, 3584)]
    seen = np.zeros(1000, int)
    for at, part, left, right in private.windows(0, "q" * 1000):
        assert len(part) <= private.WINDOW and left == (at > 0) and right == (at + len(part) < 1000)
        seen[at : at + len(part)] += 1
    assert seen.min() >= 1 and seen[48:-96].min() >= 2


@pytest.fixture(scope="module")
def tagger(spark):
    scan = private.scanned(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), []).cache()
    return private.trained(private.training_rows(private.sampled(scan)))


def test_tagger_held_out(tagger):
    """Made spans of another seed in words that were not trained on: added spans are mostly right, most are found."""
    draw = np.random.default_rng(8)
    lines = [" ".join("".join(draw.choice(list("aeionrst"), draw.integers(2, 9))) for _ in range(14)) for _ in range(400)]
    right = wrong = missed = 0
    for text, spans in private.training_rows(lines, made=1, seed=91):
        wanted = {s for s in spans if private.passes(s[0], text[s[1] : s[2]])}
        got = {tuple(s[1:]) for s in private.added(tagger, [[(0, text)]], [[]])[0]}
        right, wrong, missed = right + len(got & wanted), wrong + len(got - wanted), missed + len(wanted - got)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.75, (right, wrong, missed)


def test_private_edges(spark, tagger):
    values = [(1, "write to jo.smith (at) example.org now"), (1, None), (None, ""), (2, "no data at all. " * 100_000 + "mail a.b@c.de"), (3, "7536784127813050 4845168114407329 paid"), (4, "sum 3.14 of 2024-01-02, @home"), (4, "sum 3.14 of 2024-01-02, @home")]
    docs = table(spark, values).withColumn("spans", F.lit(1)).withColumn("kind", F.lit("x"))
    out = private.found(docs, learn=lambda texts: tagger)
    got = {(r["doc_id"], r["text"]): ([(s["kind"], s["start"], s["end"]) for s in r["base"]], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in out.collect()}
    assert out.columns == ["doc_id", "text", "kind", "base", "spans"] and out.count() == len(values)
    assert got[(1, None)] == got[(None, "")] == got[values[5]] == ([], [])
    assert got[values[3]][0] == [("email", 1_600_005, 1_600_013)]
    assert got[values[4]] == ([], [("card", 17, 33)])
    assert got[values[0]] == ([], [("email", 9, 34)])
    masked = {r["text"] for r in private.redacted(out).collect()}
    assert "write to [EMAIL] now" in masked and "7536784127813050 [CARD] paid" in masked and None in masked
    assert private.found(table(spark, [])).count() == 0


def test_private_query_base(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op11_private_spans(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        base = plain_base(docs[r["doc_id"]])
        names = [f"{private.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r["spans"].split(","))
