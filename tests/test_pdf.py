"""The PDF reader on hand-made files: objects, filters, fonts, tables from rules, damaged files, page limits."""

import base64
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.plans import registry
from ragloom.sources import pdf
from ragloom.sources.pdf_writer import written


def made(objects: dict[int, bytes], tail: bytes = b"") -> bytes:
    """A file of these objects with its table; object 1 is the catalog."""
    out, places = bytearray(b"%PDF-1.4\n"), {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj %s endobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in places.items())
    return bytes(out + b"trailer << /Root 1 0 R /Size 99 %s >>\nstartxref\n%d\n%%%%EOF" % (tail, at))


def stream(data: bytes, more: bytes = b"") -> bytes:
    return b"<< /Length %d %s >> stream\n%s\nendstream" % (len(data), more, data)


PAGES = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F 4 0 R >> /XObject << /X 6 0 R >> >> >>",
    3: b"<< /Type /Page /Contents [5 0 R 7 0 R] >>",
    4: b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [250] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /uni20AC 65 /B] >> >>",
    6: stream(b"BT /F 8 Tf 5 5 Td (form) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0]"),
}


def texts(raw):
    return [[(m[6], round(m[1]), round(m[2])) for m in page if m[0] == "text"] for page in pdf.marks(raw)]


def test_content_and_fonts():
    first = base64.a85encode(zlib.compress(rb"BT /F 10 Tf 20 700 Td [(a\(b\)) -300 (\101\102) 100 (c)] TJ 14 TL T* (n\145xt) ' ET"), adobe=True)
    second = b"BT /F 10 Tf 1 0 0 1 20 600 Tm <0102> Tj ET BI /W 1 ID \x00(EI EI q 2 0 0 2 10 10 cm BT /F 10 Tf 5 5 Td (scaled) Tj ET Q /X Do"
    raw = made(PAGES | {5: stream(first, b"/Filter [/ASCII85Decode /FlateDecode]"), 7: stream(second)})
    assert texts(raw) == [[("a(b) BBc", 20, 700), ("next", 20, 672), ("é€", 20, 600), ("scaled", 20, 20), ("form", 105, 5)]]
    size = [m[5] for m in pdf.marks(raw)[0] if m[6] == "scaled"]
    assert size == [20]


def test_later_tables_win_and_damage_is_searched():
    raw = made(PAGES | {5: stream(b"BT /F 10 Tf 0 0 Td (old) Tj ET"), 7: stream(b"")})
    at = int(raw.split(b"startxref\n")[1].split()[0])
    place = len(raw) + 1
    body = b"5 0 obj " + stream(b"BT /F 10 Tf 0 0 Td (new) Tj ET") + b" endobj\n"
    more = raw + b"\n" + body
    newer = more + b"xref\n5 1\n%010d 00000 n \ntrailer << /Root 1 0 R /Prev %d >>\nstartxref\n%d\n" % (place, at, len(more))
    assert texts(newer) == [[("new", 0, 0)]]
    assert texts(raw.replace(b"startxref", b"startxxxx")) == texts(raw.replace(b"%d\n%%%%EOF" % at, b"7\n%%EOF")) == [[("old", 0, 0)]]
    with pytest.raises(ValueError, match="no page tree"):
        pdf.marks(raw[:40])
    with pytest.raises(ValueError, match="encrypted"):
        pdf.marks(made(PAGES | {5: stream(b""), 7: stream(b"")}, b"/Encrypt 9 0 R"))


def test_round_pages_and_references_end():
    assert texts(made(PAGES | {2: b"<< /Type /Pages /Kids [2 0 R 3 0 R 3 0 R] >>", 5: stream(b""), 7: stream(b"")})) == [[]]
    with pytest.raises(ValueError):
        pdf.marks(made(PAGES | {2: b"8 0 R", 8: b"2 0 R"}))
    with pytest.raises(RecursionError):
        pdf.marks(made({1: b"<< /Pages " + b"[" * 100_000}))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab (é€𝒳\\<", min_size=1, max_size=9).filter(lambda t: t.strip()), max_size=4), min_size=1, max_size=4), st.booleans())
def test_writer_round_trip(pages, packed):
    raw = written([{"lines": p} for p in pages], packed)
    assert [[m[6] for m in page] for page in pdf.marks(raw)] == pages
    assert [[m[6] for m in page] for page in pdf.marks(raw[:-30])] == pages  # without its end


def lines_of(spark, files, **options):
    frame = spark.createDataFrame(files, "name string, content binary")
    out = pdf.lines(pdf.placed(frame, "name", **options).cache(), "name")
    return {(r["name"], r["page"], r["line_no"]): r["line"] if r["error"] is None else r["error"] for r in out.collect()}


def test_tables_and_texts(spark):
    boxed = rb"BT /F 10 Tf 12 88 Td (Name) Tj 50 0 Td (Old) Tj -2 -10 Td (age) Tj -48 -10 Td (Eve) Tj 50 0 Td (4) Tj ET 10 80 100 20 re 10 60 100 20 re S 60 60 m 60 100 l S BT /F 10 Tf 300 20 Td (beside) Tj ET 300 300 m 310 300 l S"
    filled = b"10 100 100 1 re f 10 80 100 1 re f 10 60 100 1 re f 10 60 1 40 re f 60 60 1 40 re f 110 60 1 40 re f BT /F 10 Tf 12 88 Td (a) Tj 50 0 Td (b) Tj -50 -20 Td (1) Tj ET"
    one_column = b"10 60 100 40 re S 10 80 m 110 80 l S BT /F 10 Tf 12 88 Td (in a box) Tj 0 -20 Td (below) Tj ET"
    gap = b"BT /F 10 Tf 10 50 Td (left) Tj 60 0 Td (right) Tj -60 -12 Td (under) Tj ET"
    file = lambda c: made(PAGES | {5: stream(c), 7: stream(b"")})
    got = lines_of(spark, [("boxed", file(boxed)), ("filled", file(filled)), ("one", file(one_column)), ("gap", file(gap)), ("bad", b"nothing"), ("none", None), ("empty", file(b"")), ("eleven", written([{"lines": ["x"]}] * 11))])
    assert got == {
        ("boxed", 1, 0): "name Eve old age 4", ("filled", 1, 0): "a 1", ("one", 1, 0): "in a box below", ("gap", 1, 0): "left right under",
        ("bad", None, 0): "no page tree", ("none", None, 0): "no page tree", ("eleven", None, 0): "11 pages, more than 10",
    }
    assert len(lines_of(spark, [("eleven", written([{"lines": ["x"]}] * 11))], max_pages=None)) == 11
    long = written([{"lines": [" ".join(f"w{k}" for k in range(a, a + 10)) for a in range(0, 600, 10)]}], packed=True)
    found = lines_of(spark, [("long", long)])
    assert [found["long", 1, k].split()[0] for k in range(len(found))] == ["w0", "w225", "w450"]


def test_the_query_reads_files_of_any_number_of_pages(spark, tmp_path):
    docs = [(1, " ".join(f"w{k}" for k in range(4500)), "en", "web", 5), (7, " ".join(f"v{k}" for k in range(8100)), None, "web", 6), (10, "short", "en", None, 7)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["pdf_pages"](spark, str(tmp_path)).collect()
    assert all(r["error"] is None and r["digest"] is not None for r in found)
    pages = {i: sorted({r["page"] for r in found if r["doc_id"] == i}) for i in (1, 7, 10)}
    assert pages == {1: [*range(1, 14)], 7: [*range(1, 23)], 10: [1, 2]}


def test_fonts_and_packed_objects_are_read_once_a_file(monkeypatch):
    fonts, packs = [], []
    font, packed = pdf.Font.__init__, pdf.File._packed
    monkeypatch.setattr(pdf.Font, "__init__", lambda *a: fonts.append(1) or font(*a))
    monkeypatch.setattr(pdf.File, "_packed", lambda *a: packs.append(1) or packed(*a))
    raw = written([{"lines": [f"page {k}"]} for k in range(30)], packed=True)
    assert [[m[6] for m in page] for page in pdf.marks(raw)] == [[f"page {k}"] for k in range(30)]
    assert len(fonts) == len(packs) == 1


def test_pages_of_fonts_of_one_name_keep_their_own():
    kinds = [b"<< /Type /Font /Encoding << /Differences [65 /%s] >> >>" % n for n in (b"one", b"two")]
    page = lambda k, at: b"<< /Type /Page /Contents %d 0 R /Resources << /Font << /F %s >> >> >>" % (at, k)
    raw = made({1: PAGES[1], 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 9 0 R] >>", 3: page(kinds[0], 5), 4: page(kinds[1], 5), 9: page(b"8 0 R", 5), 8: kinds[1], 5: stream(b"BT /F 10 Tf 1 0 0 1 5 5 Tm (AB) Tj /G 8 Tf (AB) Tj ET")})
    assert [[t[0] for t in page] for page in texts(raw)] == [["1B", "AB"], ["2B", "AB"], ["2B", "AB"]]


def test_runs_are_joined_as_a_plain_model_does(spark):
    draw, rows, wanted = random.Random(4), [], {}
    for page in range(60):
        runs = [(draw.choice([0.0, 1.5, 3.0, 9.0, 12.5, 30.0]), draw.choice([0.0, 4.0, 9.0, 9.5]), k, draw.choice([8.0, 10.0]), draw.choice("abé")) for k in range(draw.randint(0, 12))]
        rows += [("f", page, "page", -1, None, None, None, None, None)] + [("f", page, "text", k, x, y, x + 3.0, size, t) for y, x, k, size, t in runs]
        found, last = [], None
        for y, x, k, size, t in sorted(runs, key=lambda r: (-r[0], r[2])):
            if last is None or last - y > pdf.NEAR:
                found.append([])
            found[-1].append((x, k, size, t))
            last = y
        for line in found:
            line.sort()
        wanted[page] = "\n".join("".join((" " if i and x - (line[i - 1][0] + 3.0) > pdf.GAP * size else "") + t for i, (x, _, size, t) in enumerate(line)) for line in found)
    frame = spark.createDataFrame(rows, "file string, page int, kind string, seq int, x double, y double, x1 double, size double, text string")
    out = pdf.page_texts(frame, "file")
    assert {r["page"]: r["text"] for r in out.collect()} == wanted
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
