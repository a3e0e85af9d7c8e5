"""Learnt sentence borders against a plain model over the documents, and hand-made cases."""

import math
import re
from collections import Counter, defaultdict

import pytest
import regex

from conftest import SF
from ragloom.operators import borders, chunking

OPEN, CLOSE = "\"'([{«“‘„", "\"')]}»”’"


def shape(word):
    body = word.lstrip(OPEN).rstrip(CLOSE)
    base = re.sub(r"[.!?…,;:–]+$", "", body).lower()
    stop = "e" if re.search(r"(\.\.|…)$", body) else "." if body.endswith(".") else "b" if body[-1:] in ("!", "?") else ""
    case = "U" if regex.match(r"\p{Lu}", body) else "l" if regex.match(r"\p{Ll}", body) else ""
    return ("##" if re.fullmatch(r"[-+]?[.,]?[0-9][0-9.,:%/-]*", base) else base), stop, case


def tied(a, b, ab, n):
    part = lambda k, m, q: 0 if q <= 0 or q >= 1 else k * math.log(q) + (m - k) * math.log(1 - q)
    return -2 * (part(ab, a, b / n) + part(b - ab, n - a, b / n) - part(ab, a, ab / a) - part(b - ab, n - a, (b - ab) / (n - a)))


class Plain:
    def __init__(self, texts):
        pairs = []
        for text in texts:
            for line in re.split(r"\n+", text or ""):
                before = ("", "^", "")
                for word in line.split():
                    now = shape(word)
                    if now[0]:
                        pairs.append((before[0] if before[1] == "." else "", before[1], now[0], now[2], now[1]))
                    before = now
        n, many, stopped = len(pairs), Counter(p[2] for p in pairs), Counter(p[2] for p in pairs if p[4] == ".")
        share, self.abbr = sum(stopped.values()) / max(1, n), set()
        for t, k in stopped.items():
            if t != "##" and regex.search(r"\p{L}", t):
                inner, rest = t.count("."), many[t] - k
                letters = len(t) - inner
                ratio = -2 * (k * math.log(share + 1e-8) + rest * math.log(1 - share + 1e-8) - k * math.log(0.99) - rest * math.log(0.01))
                if ratio * math.exp(-letters) * (inner + 1) * letters**-rest >= 0.3:
                    self.abbr.add(t)
        ends = lambda p: p[1] == "b" or p[1] == "." and p[0] not in self.abbr
        at, ended = Counter(p[2] for p in pairs if ends(p) and regex.match(r"\p{L}", p[2])), sum(map(ends, pairs))
        self.starters = {t for t, k in at.items() if n / ended > many[t] / k and tied(ended, many[t], k, n) >= 30}
        both = Counter((p[0], p[2]) for p in pairs if p[1] == "." and (p[0] in self.abbr or p[0] == "##" or regex.fullmatch(r"\p{L}", p[0])) and regex.match(r"\p{L}", p[2]) and p[2] not in self.starters)
        self.coll = {(a, b) for (a, b), k in both.items() if many[a] and n / many[a] > many[b] / k and tied(many[a], many[b], k, n) >= 7.88}
        self.seen = defaultdict(set)
        for p in pairs:
            where = "start" if ends(p) or p[1] == "^" else "in" if p[1] == "" else "?"
            self.seen[p[2]] |= {(where, p[3]), ("any", p[3])}

    def ends(self, word, after):
        (key, stop, _), (kind, _, case) = shape(word), shape(after)
        if stop not in (".", "e"):
            return True
        seen = self.seen[kind]
        if not kind:
            return stop == "." and key not in self.abbr
        says_end = case == "U" and ("any", "l") in seen and ("in", "U") not in seen
        says_on = case == "l" and (("any", "U") in seen or ("start", "l") not in seen)
        if stop == "." and (key, kind) in self.coll:
            return False
        if stop == "." and (key == "##" or regex.fullmatch(r"\p{L}", key)):
            return not (says_on or not says_end and key != "##" and case == "U" and ("any", "l") not in seen)
        if stop == "e" or key in self.abbr:
            return says_end or case == "U" and kind in self.starters
        return True

    def sentences(self, text):
        out = []
        for line in re.split(r"\n+", text or ""):
            held, words = [], line.split()
            for word, after in zip(words, [*words[1:], None]):
                held.append(word)
                if after is None or re.search(rf"[.!?…][{re.escape(CLOSE)}]*$", word) and self.ends(word, after):
                    out.append(" ".join(held))
                    held = []
        return out


def test_borders_equal_a_plain_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    plain, found = Plain(texts.values()), borders.learnt(docs)
    assert {r["type"] for r in found.abbreviations.collect()} == plain.abbr
    assert {r["type"] for r in found.starters.collect()} == plain.starters
    assert {(r["a"], r["b"]) for r in found.collocations.collect()} == plain.coll
    got = {r["doc_id"]: r["sentences"] for r in borders.sentences(docs, found).collect()}
    assert got == {i: plain.sentences(t) for i, t in texts.items()}


TEXTS = ["Dr. Meier kam um 9 Uhr. Er ging z.B. heim... Dann nicht! (Ja.) Neu\nZeile"] * 30 + ["Der dr. sagte nichts. Er kam am 3. Mai zu J. Bach. Sie auch", "", None, " \n\n ", "Ende.\" Er kam. \n er ging"] * 10


def test_borders_of_abbreviations(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found, plain = borders.learnt(docs), Plain(TEXTS)
    assert {"dr", "z.b"} <= plain.abbr == {r["type"] for r in found.abbreviations.collect()}
    got = {r["doc_id"]: r["sentences"] for r in borders.sentences(docs, found).collect()}
    assert got == {i: plain.sentences(t) for i, t in enumerate(TEXTS)}
    assert got[0][0].startswith("Dr. Meier kam um 9 Uhr.") and got[0][-1] == "Zeile" and got[31] == got[32] == got[33] == []
    # a corpus that was not learnt from
    other = spark.createDataFrame([(1, "Frau Dr. Zeta spricht. Alle hören. Xyz.")], "doc_id long, text string")
    assert borders.sentences(other, found).first()["sentences"] == ["Frau Dr. Zeta spricht.", "Alle hören.", "Xyz."]


def test_borders_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    found = borders.learnt(empty)
    assert found.abbreviations.count() == found.decisions.count() == borders.sentences(empty, found).count() == 0
    one = spark.createDataFrame([(1, "A b. C d")], "doc_id long, text string")
    assert borders.sentences(one, found).first()["sentences"] == ["A b.", "C d"]


@pytest.mark.parametrize("compat", [False, True])
def test_three_tiers(compat):
    words = lambda n, end="": " ".join(["w"] * n) + end
    # the first tier's sentence is too long; marks in it split it, and a part without marks is cut into windows
    parts = [words(100, "."), words(90, "; ") + words(90, "; ") + words(300, ".") + " x"]
    got = chunking.three_tiers(parts, compat=compat)
    assert all(len(c.split()) <= 250 + 50 * compat for c in got) and sum("x" in c.split() for c in got) >= 1
    assert len(got) >= 4 and chunking.three_tiers([]) == []


def test_three_tier_chunks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plain = Plain([r["text"] for r in docs.collect()])
    wanted = {r["doc_id"]: chunking.three_tiers(plain.sentences(r["text"])) for r in docs.collect()}
    from ragloom.plans import registry

    got = defaultdict(dict)
    for r in registry.QUERIES["three_tier_chunks"](spark, SF).collect():
        got[r["doc_id"]][r["chunk_no"]] = r["chunk"]
    assert {i: [c[k] for k in range(len(c))] for i, c in got.items()} == {i: c for i, c in wanted.items() if c}
    assert max(len(c.split()) for x in wanted.values() for c in x) <= 250
