"""Text, chunk, table, file and score functions on small cases."""

import io
import re
import unicodedata
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.functions import scoring, text
from ragloom.operators import chunking, html, qa, sync
from ragloom.sources import office


def values(spark, column, cases):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r["y"] for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_clean(x):
    x = re.sub(r"^[•\-]\s*", "", x)
    x = re.sub(r"\s+", " ", x).strip()
    x = re.sub(r"(.)\1{4,}", r"\1", x, flags=re.I | re.S)
    return unicodedata.normalize("NFKC", x)


def test_clean(spark):
    cases = ["• one", " • two", "-three", "a 　 b", "aaaa", "aaaaa", "AaAaAa b", "Đđđđđđ", "ﬁne ①", "", "x\x1cy"]
    assert values(spark, text.clean, cases) == [plain_clean(c) for c in cases]
    assert values(spark, text.clean, [None]) == [None]


def test_names_and_types(spark):
    assert values(spark, text.extension, ["application/pdf", "application/pdf; charset=x", None]) == [".pdf", "", ""]
    long = "https://a/" + "b" * 300
    assert len(values(spark, lambda c: text.safe_filename(c, F.lit(".pdf")), [long])[0]) == 200
    links = ["/x", "y", "//h/z", "http://q"]
    assert values(spark, lambda c: text.resolved(F.lit("https://s.org/a/b"), c), links) == ["https://s.org/x", "https://s.org/a/y", "https://h/z", "http://q"]


@pytest.mark.parametrize("n, count", [(0, 0), (1, 1), (250, 1), (251, 2), (475, 2), (476, 3)])
def test_windows(spark, n, count):
    frame = spark.createDataFrame([(" ".join(["w"] * n),)], "text string")
    assert chunking.token_windows(frame).count() == count


words = lambda n, c="w": " ".join([c] * n)


def test_pack():
    parts = [words(2, "a"), words(6, "b"), words(4, "c"), words(4, "d")]
    assert [len(c.split()) for c in chunking.pack(parts, 10, 3, compat=True, length=lambda s: len(s.split()))] == [8, 14]
    assert [len(c.split()) for c in chunking.pack(parts, 10, 3, compat=True)] == [2, 8, 10, 8]  # with the two special tokens of each length
    assert all(len(c.split()) <= 10 for c in chunking.pack(parts, 10, 3))
    assert chunking.pack([words(12)], 10, 3, compat=True)[0] == ""
    assert chunking.pack([words(12)], 10, 3) == [words(12)]


@given(st.lists(st.integers(1, 15), max_size=30), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_pack_progress(sizes, overlap):
    parts = [words(n, f"s{i}") for i, n in enumerate(sizes)]
    chunks = chunking.pack(parts, 10, overlap)
    assert all(chunks) and len(chunks) <= len(parts)
    assert [p for p in parts if not any(p in c for c in chunks)] == []


def test_tables_and_headings():
    table = lambda x: html.table_text(html.parsed(x).find("table")[0])
    assert table("<table><thead><tr><th>A<th>B</thead><tbody><tr><td>1<td>2<tr><td><td></tbody></table>") == "A là 1\tB là 2"
    assert table("<table><tr><td>A<td>B<tr><td>1</table>") == "A là 1"
    assert table("<table></table>") == "" and table("<table><thead><tr><th>A</thead></table>") == ""
    node = lambda x: html.parsed(x).children[0]
    assert html.is_heading(node("<p><b>123</b>45</p>")) and not html.is_heading(node("<p><b>12</b>345</p>"))
    assert html.node_text(node("<ul><li>a<li><b>c</b></ul>")) == "• a\nc"
    assert html.node_text(node("<p>t<img alt='x'></p>")) == "[Hình: x]\nt"
    assert html.page_nodes("<p>no root</p>") == [] and html.main_content("") == ("", "")
    pages = html.page_nodes("<title>T</title><article><p>before<h2>H</h2><p>body<p><b>open</article>")
    assert [(h, t) for _, h, t, _ in pages] == [(0, "before"), (1, "H"), (0, "body"), (1, "open")]


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/").replace("_rels", "_rels").replace("_xml", ".xml"), content)
    return out.getvalue()


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('Name')}{cell('Age')}</w:tr><w:tr>{cell('Ann')}{cell('4')}</w:tr></w:tbl>"
    both = f"<w:document {w}><w:body><w:p><w:r><w:t>para</w:t></w:r></w:p>{table}</w:body></w:document>"
    assert office.docx_lines(zipped(word__document_xml=both)) == ["name Ann age 4"]
    alone = f"<w:document {w}><w:body><w:p><w:r><w:t>para</w:t></w:r></w:p></w:body></w:document>"
    (tmp_path / "a.docx").write_bytes(zipped(word__document_xml=alone))
    (tmp_path / "b.docx").write_bytes(b"broken")
    found = {r["path"].rpartition("/")[2]: r for r in office.read_lines(spark, str(tmp_path)).collect()}
    assert found["a.docx"]["line"] == "para" and found["b.docx"]["error"]
    assert office.folders_of(spark, str(tmp_path), "a.docx").count() == 1


def test_xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    cells = [("A1", "Title"), ("A2", "Name"), ("B2", "Age"), ("A3", "Ann"), ("B3", "4"), ("B4", "no first"), ("A5", "late")]
    data = "".join(f'<row r="{ref[1:]}">{cell(ref, v)}</row>' for ref, v in cells)
    raw = zipped(
        xl__workbook_xml=f'<workbook {s} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        xl___rels__workbook_xml=f"<x/>",
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", zipfile.ZipFile(io.BytesIO(raw)).read("xl/workbook.xml"))
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {s}><sheetData>{data}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    assert office.xlsx_rows(out.getvalue()) == ("Title", ["name Ann age 4"])
    assert office.pdf_lines([("x", [])] * 11) == [] and office.pdf_lines([("x", [[["A", "B"], ["1", "2"]]])]) == ["a 1 b 2"]


def test_scores(spark):
    assert scoring.sentence_bleu("a b c d e".split(), "a b c d e".split()) == pytest.approx(1)
    assert scoring.sentence_bleu(["a"], ["a"]) == 0 and scoring.sentence_bleu("a b".split(), "c d".split()) == 0
    frame = spark.createDataFrame([("a b c d", "a x c d"), ("", "a"), (None, None)], "a string, b string")
    assert [round(r[0], 4) for r in frame.select(scoring.rouge_l("a", "b")).collect()] == [0.75, 0, 0]
    ranks = spark.createDataFrame([([5, 7], 5), ([5, 7], 7), ([5], 9)], "ids array<bigint>, r bigint")
    assert [tuple(x) for x in ranks.select(scoring.recall_at_k(F.col("ids"), F.col("r")), scoring.reciprocal_rank(F.col("ids"), F.col("r"))).collect()] == [(1, 1.0), (1, 0.5), (0, 0.0)]


def test_models(spark):
    frame = spark.createDataFrame([("c1\nc2", "q")], "c string, q string")
    assert qa.asked(frame, qa.answer_messages(F.col("c"), F.col("q"))).first()["answer"] == "c1"

    def broken(messages):
        raise RuntimeError("down")

    assert qa.asked(frame, qa.answer_messages(F.col("c"), F.col("q")), chat=broken).first()["answer"] == "error: down"
    assert values(spark, qa.mark, ["7.5 of 10", "99", "none"]) == [7.5, 10.0, None]


def test_refreshed_vectors(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, t string, vector int")
    new = spark.createDataFrame([(1, "a", 0), (2, "c", 0), (3, "d", 0)], "id int, t string, vector int")
    assert sorted(map(tuple, sync.refreshed_vectors(old, new, "id", "t").collect())) == [(1, "a", 1), (2, "c", 0), (3, "d", 0)]


def test_stream_equals_batch(spark, tmp_path):
    from ragloom.streaming import incremental

    rows = spark.createDataFrame([(i % 7, i) for i in range(50)], "k int, v int").withColumn("ts", F.timestamp_seconds("v"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    incremental.synced(stream, lambda b: seen.extend(map(tuple, b.select("k", "v").collect())), str(tmp_path / "cp"), "k", "ts").awaitTermination()
    assert sorted(seen) == sorted((k, max(v for v in range(50) if v % 7 == k)) for k in range(7))
    first = incremental.first_seen(stream, "k").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    first.awaitTermination()
    assert spark.table("firsts").count() == 7
