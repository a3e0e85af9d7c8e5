"""HTML to nodes, tables and text: a small tree over the standard parser, walked in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: elements without an end tag, those whose text is no content, those that open a section
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_BOLD, _LISTS = ("b", "strong"), ("ul", "ol")
# fixed values: which open elements a start tag ends, and how far up they are looked for
_ENDS = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")} | dict.fromkeys(("p", "div", "section", "article", "ul", "ol", "table", *HEADINGS), ("p",))
_BOUNDS = frozenset(("table", "ul", "ol", "article", "div", "section", "#root"))
#: Share of bold text from which a node is a heading.
BOLD_SHARE = 0.6


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings

    def walk(self, skip: tuple[str, ...] = ()):
        """All elements within, in order, by a stack; those of the tags in `skip` come but not what they hold."""
        open_ = [iter(self.children)]
        while open_:
            for c in open_[-1]:
                if isinstance(c, Node):
                    yield c
                    if c.tag not in skip:
                        open_.append(iter(c.children))
                        break
            else:
                open_.pop()

    def find(self, *tags: str, skip: tuple[str, ...] = ()) -> list[Node]:
        return [n for n in self.walk(skip) if n.tag in tags]

    def strings(self, skip: tuple[str, ...] = ()):
        """The strings within, in order, without those of silent elements and of the tags in `skip`."""
        open_ = [iter(self.children)]
        while open_:
            for c in open_[-1]:
                if isinstance(c, str):
                    yield c
                elif c.tag not in _SILENT and c.tag not in skip:
                    open_.append(iter(c.children))
                    break
            else:
                open_.pop()

    def text(self, apart: str = " ", skip: tuple[str, ...] = ()) -> str:
        return apart.join(t for s in self.strings(skip) if (t := " ".join(s.split())))


class _Builder(HTMLParser):
    """End tags close the nearest open element of their name; without one they are ignored, and what stays open ends with its parent.

    A block that starts ends an open paragraph with all that is open in it; items, rows and cells end their like.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("#root")]

    def handle_starttag(self, tag, attrs):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in _ENDS.get(tag, ()):
                del self.open[i:]
                break
            if self.open[i].tag in _BOUNDS:
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parsed(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.open[0]


def table_rows(table: Node) -> tuple[list[str], list[list[str]]]:
    """(headers, rows of cells): headers from the head, else from the first row; a head without a body has no rows.

    Rows of a table within a cell are that cell's text.
    """
    own = lambda node, *tags: node.find(*tags, skip=("table",))
    head = own(table, "thead")
    cells = lambda row: [c.text() for c in row.children if isinstance(c, Node) and c.tag in ("th", "td")]
    if head:
        headers = [c.text() for h in head for r in own(h, "tr") for c in r.children if isinstance(c, Node) and c.tag in ("th", "td")]
        return headers, [cells(r) for b in own(table, "tbody") for r in own(b, "tr")]
    rows = [cells(r) for r in own(table, "tr")]
    return (rows[0], rows[1:]) if rows else ([], [])


def table_text(table: Node, is_: str = "là") -> str:
    """`header is value` cells apart by tabs, rows by `. `; cells pair up to the shorter side, empty rows are left out."""
    headers, rows = table_rows(table)
    return ". ".join("\t".join(f"{h} {is_} {v}" for h, v in zip(headers, row, strict=False)) for row in rows if any(row))


def is_heading(node: Node) -> bool:
    """h1 to h6, or text that is mostly bold; nested bold elements count once each."""
    if node.tag in HEADINGS:
        return True
    whole = len(node.text(""))
    bold = whole if node.tag in _BOLD else sum(len(n.text("")) for n in node.find(*_BOLD, skip=_BOLD))
    return whole > 0 and bold / max(1, whole) >= BOLD_SHARE


def _list_lines(node: Node) -> list[str]:
    """A line for each item, bulleted unless heading-like, with all text in it; what is beside the items in lines of its own."""
    out = []
    for c in node.children:
        text = " ".join(c.split()) if isinstance(c, str) else "" if c.tag in _SILENT or c.tag == "table" else c.text(skip=("table",))
        if text:
            out.append(f"• {text}" if isinstance(c, Node) and c.tag == "li" and not is_heading(c) else text)
    return out


def node_text(node: Node) -> str:
    """Tables first, wherever they are; then a list's items, an image's alternative text, or all other text flat, after the texts of images in it."""
    if node.tag == "table":
        return table_text(node)
    parts = [t for x in node.find("table", skip=("table",)) if (t := table_text(x))]
    images = [node] if node.tag == "img" else [] if node.tag in _LISTS else node.find("img", skip=("table",))
    parts += [f"[Hình: {i.attrs['alt'].strip()}]" for i in images if i.attrs.get("alt", "").strip()]
    parts += _list_lines(node) if node.tag in _LISTS else [t] if (t := node.text(skip=("table",))) else []
    return "\n".join(parts)


def _matches(node: Node, selector: str) -> bool:
    """Whether a `tag.class.class` selector fits; either part may be left out."""
    tag, *classes = selector.split(".")
    return (not tag or node.tag == tag) and set(classes) <= set(node.attrs.get("class", "").split())


def _root(page: Node, selector: str) -> Node | None:
    return next((n for n in page.walk() if _matches(n, selector)), None)


def _title(page: Node, selector: str = "h2.single-content-title") -> str:
    """The first of: the element of the content's own title, the first h1, the title of the page; empty without any."""
    for one in (selector, "h1", "title"):
        if (n := _root(page, one)) is not None:
            return n.text()
    return ""


def page_nodes(html: str, root: str = "article", bare: bool = False) -> list[tuple[int, int, str, str]]:
    """(pos, is_heading, text, title) of the child elements of the page's root (`tag.class`) that have text; none without a root.

    Text of the root that is in no child element is left out, unless `bare`.
    """
    page = parsed(html)
    main = _root(page, root)
    if main is None:
        return []
    title = _title(page)
    out: list[tuple[int, int, str, str]] = []
    for c in main.children:
        if isinstance(c, str):
            heading, text = 0, " ".join(c.split()) if bare else ""
        elif c.tag in _SILENT:
            continue
        else:
            heading = int(is_heading(c))
            text = c.text() if heading else node_text(c)
        if text:
            out.append((len(out), heading, text, title))
    return out


def _flat(node: Node) -> list[str]:
    """The stripped strings of a node, each table as one string in its place."""
    out: list[str] = []
    open_ = [iter(node.children)]
    while open_:
        for c in open_[-1]:
            if isinstance(c, str):
                out.append(" ".join(c.split()))
            elif c.tag == "table":
                out.append(table_text(c))
            elif c.tag not in _SILENT:
                open_.append(iter(c.children))
                break
        else:
            open_.pop()
    return [x for x in out if x]


def main_content(html: str, root: str = "article") -> tuple[str, str]:
    """(title, flat text of the root with each table's text in its place); both empty without the root."""
    page = parsed(html)
    main = _root(page, root)
    return ("", "") if main is None else (_title(page), " ".join(_flat(main)))


def _tried(make: Callable[[str], object]) -> Callable[[str | None], tuple[object, str | None]]:
    """(result, error): one bad page is not the others' failure; a null page has neither."""

    def run(html: str | None) -> tuple[object, str | None]:
        try:
            return (None, None) if html is None else (make(html), None)
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    return run


def nodes(pages: DataFrame, html_col: str = "html", root: str = "article", bare: bool = False) -> DataFrame:
    """A row for each node of each page: pos, is_heading, text, title, error, with the page's other columns.

    A page that fails has one row with its error and nulls, of which `sections` makes nothing.
    """
    make = _tried(lambda x: page_nodes(x, root, bare))
    kind = "array<struct<pos:int,is_heading:int,text:string,title:string,error:string>>"

    def rows(html: str | None) -> list[dict]:
        found, error = make(html)
        if error is not None:
            return [{"pos": None, "is_heading": None, "text": None, "title": None, "error": error}]
        return [{"pos": p, "is_heading": h, "text": t, "title": m, "error": None} for p, h, t, m in found or []]

    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([rows(x) for x in column], dtype=object)

    return pages.withColumn("_made", F.explode(run(F.col(html_col)))).drop(html_col).select("*", "_made.*").drop("_made")


def contents(pages: DataFrame, html_col: str = "html", root: str = "article") -> DataFrame:
    """The pages' other columns with title and content, both empty where the page is null or fails."""
    make = _tried(lambda x: main_content(x, root))

    @F.pandas_udf("title string, content string")
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([make(x)[0] or ("", "") for x in column], columns=["title", "content"])

    return pages.withColumn("_made", run(F.col(html_col))).drop(html_col).select("*", "_made.*").drop("_made")
