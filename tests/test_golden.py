"""Golden cases of rules that no SQL holds: links, titles, tables in place, page windows, packing, scores, answers with a status."""

import math
from collections import Counter
from urllib.parse import urljoin

from pyspark.sql import functions as F

from conftest import SF
from ragloom.functions import text
from ragloom.operators import chunking, html, serving
from ragloom.plans import registry
from ragloom.sources import office


def test_links_resolve_as_the_rules_say(spark):
    pages = ["https://s.org/a/b", "https://s.org", "http://s.org/x/y/?q=1#f", "https://s.org/a/b/c.html?z"]
    links = ["/x", "y", "//h/z", "http://q", "../a", "../../..", "./k", ".", "#p", "?n=2", "mailto:x@y.z", "javascript:void(0)", "", "a/./b/../c?u=/../v", "/m/../n/."]
    cases = [(p, k) for p in pages for k in links]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, k string").select("i", text.resolved(F.col("p"), F.col("k")).alias("y"))
    assert [r["y"] for r in got.orderBy("i").collect()] == [urljoin(p, k) for p, k in cases]


def test_titles_and_tables_in_place():
    table = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>"
    page = f"<title>T</title><h1>H</h1><h2 class='big single-content-title'>C</h2><article>before {table} after <script>x</script></article>"
    assert html.main_content(page) == ("C", "before A là 1\tB là 2 after")
    assert html.main_content(page.replace("single-", ""))[0] == "H" and html.main_content(page.replace("single-", "").replace("h1", "p"))[0] == "T"
    assert html.main_content("<p>no root</p>") == ("", "")
    assert html.main_content("<div class='x content-pad y'>in</div>", "div.content-pad.x")[1] == "in"


def test_pdf_pages():
    page = " ".join(f"w{i}" for i in range(476))
    lines = office.pdf_lines([(page, []), ("left out", [[["H", None], ["1", "2"]]])])
    assert [len(x.split()) for x in lines[:3]] == [250, 250, 26] and lines[3:] == ["h 1 2"]
    try:
        office.pdf_parser(lambda raw: [("x", [])] * 11)(b"")
    except ValueError as e:
        assert "11 pages" in str(e)
    else:
        raise AssertionError
    assert len(office.pdf_lines([("x", [])] * 11, max_pages=None)) == 11


def test_character_parts():
    words = " ".join(f"word{i}" for i in range(200))
    parts = chunking.character_parts(words)
    assert all(0 < len(p) <= 250 for p in parts) and {w for p in parts for w in p.split()} == set(words.split())
    assert chunking.character_parts("x" * 600, 250, 25)[0] == "x" * 250


def test_special_tokens_count_in_compatible_packing():
    assert chunking.pack(["a b c", "d e f"], 8, 1, compat=True) == ["a b c", "d e f"]
    assert chunking.pack(["a b c", "d e f"], 8, 1) == ["a b c d e f"]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_rouge_of_table(spark):
    pairs = {(r["conv_id"], r["turn"]): (r["question"], r["answer"]) for r in registry.QUERIES["dialog_pairs"](spark, SF).collect()}
    for r in registry.QUERIES["rouge_l"](spark, SF).collect():
        q, a = pairs[r["conv_id"], r["turn"]]
        if q is None or a is None:
            continue
        x, y = q.lower().split(), a.lower().split()
        if not q.isascii() or not a.isascii() or any(not w.isalnum() for w in x + y):
            continue
        n = _lcs(x, y)
        f = 2 * n / (len(x) + len(y)) if n else 0.0
        assert math.isclose(r["rouge_l"], f, abs_tol=1e-4)


def test_answers_have_a_status(spark):
    asked = spark.createDataFrame([(0, "where?", [1.0, 0.0]), (1, "  ", [1.0, 0.0]), (2, "fail?", [0.0, 1.0]), (3, None, None)], "query long, question string, qvec array<double>")
    vectors = spark.createDataFrame([(7, "t", [1.0, 0.0]), (8, "t", [0.0, 1.0])], "id long, field string, vec array<double>")
    rows = spark.createDataFrame([(7, "here\nmore"), (8, "there")], "id long, content string")

    def chat(messages):
        if "fail" in messages[-1]["content"]:
            raise RuntimeError("down")
        return messages[-1]["content"].split("\n")[0]

    got = {r["query"]: (r["status"], r["n_ids"], r["answer"], r["error"]) for r in serving.answered(asked, vectors, rows, chat, k=1).collect()}
    assert got == {0: (200, 1, "here", None), 1: (400, 0, None, None), 2: (500, 1, None, "down"), 3: (400, 0, None, None)}
    none = serving.answered(asked.limit(1), vectors.limit(0), rows, chat)
    assert [r["status"] for r in none.collect()] == [404]


def test_stored_vectors(spark, tmp_path):
    path = str(tmp_path / "v")
    assert serving.read_vectors(spark, path).count() == 0
    frame = lambda *rows: spark.createDataFrame(list(rows), serving.VECTORS)
    serving.write_vectors(frame((1, "a", [1.0]), (1, "b", [2.0]), (1, "a", [1.0])), path)
    serving.write_vectors(frame((1, "a", [3.0])), path)
    serving.write_vectors(frame((2, "a", [4.0])), path)
    assert Counter((r["id"], r["field"], r["vec"][0]) for r in serving.read_vectors(spark, path).collect()) == Counter([(1, "a", 3.0), (1, "b", 2.0), (2, "a", 4.0)])


def test_cleaning_by_the_plain_rule(spark):
    import re
    import unicodedata

    def plain(t):
        t = re.sub(r"\s+", " ", re.sub(r"^[•\-]\s*", "", t)).strip()
        return unicodedata.normalize("NFKC", re.sub(r"(.)\1{4,}", r"\1", t, flags=re.I | re.S))

    # characters of two UTF-16 units at the end, letters that are equal by other than their lower case, wide and odd white space
    texts = ["İİİİİ", "ſsſSs!", "kKKkk", "ΣσςΣσ", "ııIIi", "aaaaA", "aaaa", "ßßßßß", "ŉŉŉŉŉ", "µμµμµ", "ĐđĐđđ", "", "𝒳𝒳𝒳𝒳𝒳", "      x", "• - a", "ﬁﬁﬁﬁﬁ", "①①①①①①b", " •a　 b\x1cc ", "a\n\n\n\n\n\nb", "-\n-", "x" * 100_000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.clean(F.col("t")).alias("y"))
    assert {r["t"]: r["y"] for r in frame.collect()} == {t: plain(t) for t in texts}
    assert spark.createDataFrame([(None,)], "t string").select(text.clean(F.col("t"))).first()[0] is None
