"""Word windows, declared tables, nested sitemaps, scanned addresses and the segmentation lattice."""

import io
import itertools
import random
import zipfile
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF
from ragloom.functions import links
from ragloom.operators import chunking, segmentation
from ragloom.operators.declared import Declared
from ragloom.plans import registry
from ragloom.sources import office, sitemaps

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def paragraph(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_word_windows(spark, tmp_path):
    words = [f"w{i}" for i in range(600)]
    raw = docx(paragraph(" ".join(words[:400])) + paragraph(" ") + paragraph(" ".join(words[400:])))
    got = office.docx_lines(raw)
    assert [x.split() for x in got] == [words[0:250], words[226:476], words[452:600]]
    assert [len(x.split()) for x in office.docx_lines(raw, overlap=25)] == [250, 250, 150] and office.docx_lines(docx("")) == []
    (tmp_path / "a.docx").write_bytes(raw)
    assert [r["line"] for r in office.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == got
    cell = lambda *t: "<w:tc>" + "".join(map(paragraph, t)) + "</w:tc>"
    inner = f"<w:tbl><w:tr>{cell('x')}</w:tr></w:tbl>"
    table = f"<w:tbl><w:tr>{cell('Name', 'Full')}{cell('Age')}</w:tr><w:tr>{cell('Ann')}<w:tc>{inner}{paragraph('4')}</w:tc></w:tr></w:tbl>"
    assert office.docx_lines(docx(paragraph("para") + table)) == ["name full Ann age x\n4"]


def test_declared_edges(spark):
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType(), False), T.StructField("s", T.StringType())])
    held = Declared(kind, key=["id"], defaults={"s": "'none'"}, checks={"small": "n < 10"}, first="n")
    rows = [("1", "2", None), ("1", "1", "b"), ("1", "1", "b"), ("1", "50", "c"), (None, "3", "d"), ("x", "3", "e"), ("2", None, "f"), ("3", "y", "g")]
    frame = spark.createDataFrame(rows, "id string, n string, s string").withColumn("breaches", F.lit("clash"))
    good, bad = held.split(frame)
    assert [tuple(r) for r in good.collect()] == [(1, 1, "b")]
    got = sorted((r["s"], tuple(r["breaches"])) for r in bad.collect())
    assert got == [("b", ("key",)), ("c", ("small",)), ("d", ("id is missing",)), ("e", ("id is missing",)), ("f", ("n is missing", "small")), ("g", ("n is missing", "small")), ("none", ("key",))]
    assert {r["rule"]: r["n"] for r in held.report(frame).collect()} == {"n is missing": 2, "id is missing": 2, "small": 3, "key": 2}
    assert {r["n"] for r in held.report(frame.limit(0)).collect()} == {0}
    assert Declared(kind).judged(frame.drop("s")).where("s is null").count() == len(rows)


def test_sitemaps_in_rounds(spark):
    index = lambda *x: "<sitemapindex xmlns='http://x/y'>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in x) + "</sitemapindex>"
    leaf = lambda *x: "<urlset>" + "".join(f"<url><loc> {u} </loc><lastmod>2024</lastmod></url>" for u in x) + "</urlset>"
    maps = [("r", index("a", "b", "gone", "broken")), ("a", index("c", "r", "a")), ("b", leaf("u1", "u2&amp;x")), ("c", leaf("u1", "")), ("broken", "no <xml"), ("other", leaf("u9")), ("empty", None)]
    frame = spark.createDataFrame(maps, "loc string, xml string")
    assert sorted((r["sitemap"], r["url"]) for r in sitemaps.reached(frame, "r").collect()) == [("b", "u1"), ("b", "u2&x"), ("c", "u1")]
    assert [r["url"] for r in sitemaps.reached(frame, "b").orderBy("place").collect()] == ["u1", "u2&x"]
    assert sitemaps.reached(frame, "nowhere").count() == 0 and sitemaps.reached(frame.limit(0), "r").count() == 0


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, [(k, v or "") for k, v in attrs]))

    handle_startendtag = handle_starttag


def made(draw):
    quote = lambda v: draw.choice([f'"{v}"', f"'{v}'", v.replace(" ", "") or "x"])
    out = []
    for _ in range(draw.randint(1, 12)):
        value = draw.choice(["/a", "b c", "http://h/x?a=1&amp;b=2", "&eacute;&#233;", "", "é", "../u", "x&notit;"])
        attributes = "".join(f" {draw.choice(['href', 'SRC', 'class', 'data-x', 'disabled'])}" + draw.choice(["", f"={quote(value)}", f" = {quote(value)}"]) for _ in range(draw.randint(0, 3)))
        out.append(draw.choice([f"<a{attributes}>", f"<IMG{attributes}/>", f"<p{attributes} >text</p>", "<!-- <a href='no'> -->", "<!doctype html>", "<script>if (a<b) '<a href=no>'</script>", "<style>a<b{}</style>", "a < b", "<1>", "</a href='x'>", "<br>"]))
    return "".join(out)


def test_scanner_equals_the_standard_parser(spark):
    draw = random.Random(3)
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [made(draw) for _ in range(3000)]
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert list(links.tags(page.encode())) == plain.found, page


def test_addresses(spark):
    page = "<base href='/dir/'><a href=x><a HREF='x'><img src=\"y?a=1&amp;b\"><a href='http://h/'><!-- <a href=no> --><a href='//[bad'>"
    assert links.addresses(page) == ["/dir/", "x", "y?a=1&b", "http://h/", "//[bad"]
    assert links.addresses(page, "https://s.org/p/q") == ["https://s.org/dir/", "https://s.org/p/x", "https://s.org/p/y?a=1&b", "http://h/", "//[bad"]
    assert links.addresses(page, "https://s.org/p/q", base=True)[1:3] == ["https://s.org/dir/x", "https://s.org/dir/y?a=1&b"]
    assert links.addresses("<a href='x") == links.addresses("") == links.addresses("<!-- <a href=x>") == []
    assert links.addresses("<" * 200_000 + "a href" * 100_000) == []
    frame = spark.createDataFrame([(page, "https://s.org/p/q"), (None, None)], "html string, url string")
    assert [r[0] for r in frame.select(links.page_links(F.col("html"))).collect()] == [links.addresses(page), None]
    wanted = [urljoin("https://s.org/p/q", x) for x in ("/dir/", "x", "y?a=1&b")]
    assert frame.select(links.page_links(F.col("html"), F.col("url"))).first()[0][:3] == wanted


def test_lattice_equals_all_splits():
    draw = random.Random(9)
    for _ in range(300):
        costs = {" ".join(draw.choice("abc") for _ in range(draw.randint(1, 3))): float(draw.randint(1, 6)) for _ in range(12)}
        lexicon, line = segmentation.Lexicon(costs, 5.0, 3), [draw.choice("abcd") for _ in range(draw.randint(1, 7))]
        ways = []
        for cuts in itertools.product([0, 1], repeat=len(line) - 1):
            words, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    words.append(line[at:i])
                    at = i
            price = [costs.get(" ".join(w), 5.0 if len(w) == 1 else None) for w in words]
            if None not in price and max(map(len, words)) <= 3:
                ways.append((sum(price), len(words), [-len(w) for w in words], words))
        assert lexicon.words(line) == min(ways)[3]


def test_segmented_lines(spark):
    docs = spark.createDataFrame([(k, f"Hà Nội là đẹp. Tôi yêu Hà Nội, {w} tôi {w}!") for k, w in enumerate("xin chào bạn mình đi về nhà nhé".split() * 3)] + [(90, None), (91, "")], "doc_id long, text string")
    lexicon = segmentation.learnt(docs, least=3)
    assert lexicon.line("(Hà Nội), hà nội Hà, Nội!") == "(Hà_Nội), hà_nội Hà, Nội!" and lexicon.line("") == "" and lexicon.line("-- ?") == "-- ?"
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", segmentation.segmented(F.col("text"), lexicon).alias("s")).collect()}
    assert got[90] == got[91] == [] and all("Hà_Nội" in got[k][0] for k in range(24))
    empty = segmentation.learnt(docs.limit(0))
    assert empty.line("a b") == "a b"


def test_segmented_chunks_of_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lexicon, got = segmentation.learnt(docs), {}
    for r in registry.QUERIES["segmented_chunks"](spark, SF).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["chunk"]
    import re

    for r in docs.collect():
        lines = [lexicon.line(s) for s in re.split(r"(?<=[.!?;–])\s+|\n+", r["text"]) if s.strip()]
        assert [got.get(r["doc_id"], {})[k] for k in range(len(got.get(r["doc_id"], {})))] == chunking.pack(lines, 256, 50)
        assert " ".join(lines).replace("_", " ").split() == r["text"].replace("_", " ").split()
