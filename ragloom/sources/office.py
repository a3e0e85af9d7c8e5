"""Word and spreadsheet files as rows of text, and a place for a PDF parser; zipped XML by the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Documents of more pages give nothing, unless another limit or none is given; tokens and overlap of a page's windows, and overlap of a Word file's.
MAX_PAGES, WINDOW, OVERLAP, WORD_OVERLAP = 10, 250, 25, 24


def _row_text(headers: list[str], row: list[str | None]) -> str:
    return " ".join(f"{h} {v}".strip() for h, v in zip(headers, row, strict=False) if v is not None and v.strip())


def _valid(table: list[list]) -> bool:
    return len(table) > 1 and len(table[0]) > 1


def docx_lines(raw: bytes, size: int = WINDOW, overlap: int = WORD_OVERLAP) -> list[str]:
    """A line for each row of its tables, headed by their first rows; where there is no table, token windows over all its paragraphs."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    said = {f"{_W}t": lambda t: t.text or "", f"{_W}tab": lambda t: "\t", f"{_W}br": lambda t: "\n", f"{_W}cr": lambda t: "\n"}
    text = lambda e: "".join(said[t.tag](t) for t in e.iter() if t.tag in said)
    tables = list(body.iter(f"{_W}tbl"))
    if not tables:
        return _windows("\n".join(t for p in body.iter(f"{_W}p") if (t := text(p)).strip()), size, overlap)
    lines = []
    for table in tables:
        cell = lambda c: "\n".join(text(p) for p in c.iter(f"{_W}p"))
        rows = [[cell(c).strip() for c in r.findall(f"{_W}tc")] for r in table.findall(f"{_W}tr")]
        if _valid(rows):
            headers = [h.lower().replace("\n", " ") for h in rows[0]]
            lines += [t for r in rows[1:] if (t := _row_text(headers, r))]
    return lines


def xlsx_cells(raw: bytes) -> tuple[list[tuple[str, int, int, str]], list[tuple[str, int, int, int, int]]]:
    """(cells (sheet, row, column, value), merges (sheet, first row, first column, last row, last column)), from 0."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    cells, merges = [], []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        name, target = sheet.get("name"), targets[sheet.get(f"{_R}id")].lstrip("/")
        page = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        for c in page.iter(f"{_S}c"):
            row, column = _place(c.get("r"))
            value = c.find(f"{_S}v")
            if c.get("t") == "inlineStr":
                out = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            elif value is None:
                continue
            else:
                out = shared[int(value.text)] if c.get("t") == "s" else value.text
            cells.append((name, row, column, out))
        for m in page.iter(f"{_S}mergeCell"):
            first, _, last = m.get("ref").partition(":")
            merges.append((name, *_place(first), *_place(last or first)))
    return cells, merges


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def xlsx_rows(raw: bytes) -> tuple[str, list[str]]:
    """(title, rows `column value …`) of the last sheet that has a header.

    The title is the text of the rows whose horizontal merges are widest; the header follows it, as deep as vertical
    merges take it; rows end at the first without a value in the first column. Without such a sheet both are empty.
    """
    cells, merges = xlsx_cells(raw)
    title, rows = "", []
    for sheet in dict.fromkeys(c[0] for c in cells):
        grid: dict[int, dict[int, str]] = {}
        for s, r, c, v in cells:
            if s == sheet and v.strip():
                grid.setdefault(r, {})[c] = v
        own = [m[1:] for m in merges if m[0] == sheet]
        wide = {r0: max(c1 - c0 for a, c0, _, c1 in own if a == r0) for r0, c0, _, c1 in own if c1 > c0}
        most = max(wide.values(), default=0)
        titles = sorted(r for r, w in wide.items() if w == most)
        begin = next((r for r in sorted(grid) if r > (titles[-1] if titles else -1)), None)
        if begin is None:
            continue
        end = max([begin, *(r1 for r0, _, r1, _ in own if r0 == begin)])
        title = " ".join(" ".join(grid[r].values()) for r in titles if r in grid)
        width = 1 + max(max(row) for row in grid.values())
        headers = []
        for c in range(width):
            levels = [grid.get(r, {}).get(c, "") for r in range(begin, end + 1)]
            headers.append(" ".join(" ".join(x for x in levels if x.strip() and not x.lower().startswith("unnamed")).split()).lower())
        rows = []
        for r in range(end + 1, 1 + max(grid)):
            if 0 not in grid.get(r, {}):
                break
            rows.append(_row_text(headers, [grid[r].get(c) for c in range(width)]))
    return title, rows


def _windows(text: str, size: int, overlap: int) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + size]) for i in range(0, max(len(words) - overlap, 1), size - overlap)] if words else []


def pdf_lines(pages: list[tuple[str, list[list[list[str | None]]]]], max_pages: int | None = MAX_PAGES, size: int = WINDOW, overlap: int = OVERLAP) -> list[str]:
    """Lines of a parsed PDF, whose pages are (text, tables): the rows of a page's first table if it is valid, else its text in token windows.

    A document of more than `max_pages` pages gives nothing; None sets no limit.
    """
    if max_pages is not None and len(pages) > max_pages:
        return []
    lines = []
    for text, tables in pages:
        if tables and _valid(tables[0]):
            headers = [(h or "").lower().replace("\n", " ") for h in tables[0][0]]
            lines += [t for r in tables[0][1:] if (t := _row_text(headers, r))]
        else:
            lines += _windows(text or "", size, overlap)
    return lines


def pdf_parser(parse: Callable[[bytes], list[tuple[str, list]]], **options) -> Callable[[bytes], list[str]]:
    """A parser for `read_lines` from any PDF library: `parse` gives the pages of a file as (text, tables). A document of too many pages has its row's error."""

    def run(raw: bytes) -> list[str]:
        pages, most = parse(raw), options.get("max_pages", MAX_PAGES)
        if most is not None and len(pages) > most:
            raise ValueError(f"{len(pages)} pages, more than {most}")
        return pdf_lines(pages, **options)

    return run


PARSERS: dict[str, Callable[[bytes], list[str]]] = {".docx": docx_lines, ".xlsx": lambda raw: xlsx_rows(raw)[1]}


def read_lines(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(path, line_no, line, error) of the files under `path` that a parser's suffix fits; a file that fails has one row with its error."""
    known = PARSERS if parsers is None else parsers
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path_, raw in zip(part["path"], part["content"], strict=True):
                try:
                    out += [(path_, i, line, None) for i, line in enumerate(known["." + path_.rpartition(".")[2].lower()](raw))]
                except Exception as e:  # noqa: BLE001 - one bad file is not the others' failure
                    out.append((path_, 0, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "line_no", "line", "error"])

    return files.where(suffix.isin(*known)).mapInPandas(run, "path string, line_no int, line string, error string")


def folders_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The distinct folders under `path` that hold a file of that name, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path).select("path")
    return files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).distinct().orderBy("folder")
