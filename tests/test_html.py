"""Pages to sections against a plain model of the rules, over the given pages and made ones; no text lost or doubled."""

import random

from conftest import SF
from ragloom.operators import chunking, html
from ragloom.plans import registry


def flat(node):
    """The stripped strings of a node, in order."""
    if isinstance(node, str):
        return [" ".join(node.split())] if node.split() else []
    return [] if node.tag in ("script", "style") else [t for c in node.children for t in flat(c)]


def inner(node, tags):
    """The outermost elements of these tags within a node."""
    out = []
    for c in node.children:
        if not isinstance(c, str):
            out += [c] if c.tag in tags else inner(c, tags)
    return out


def cut(node, tag):
    return html.Node(node.tag, node.attrs, [c if isinstance(c, str) else cut(c, tag) for c in node.children if isinstance(c, str) or c.tag != tag])


def bold(node):
    if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return True
    size = lambda n: len("".join(flat(n)))
    part = size(node) if node.tag in ("b", "strong") else sum(map(size, inner(node, ("b", "strong"))))
    return size(node) > 0 and part / size(node) >= 0.6


def said(node):
    if node.tag == "table":
        return html.table_text(node)
    out = [t for x in inner(node, ("table",)) if (t := html.table_text(x))]
    rest = cut(node, "table")
    if node.tag in ("ul", "ol"):
        for c in rest.children:
            if text := " ".join(flat(c)):
                out.append("• " + text if not isinstance(c, str) and c.tag == "li" and not bold(c) else text)
    else:
        pictures = [rest] if rest.tag == "img" else inner(rest, ("img",))
        out += [f"[Hình: {i.attrs['alt'].strip()}]" for i in pictures if i.attrs.get("alt", "").strip()]
        out += [" ".join(flat(rest))] if flat(rest) else []
    return "\n".join(out)


def sections(page, selector="article"):
    tree = html.parsed(page)
    root = next(iter(inner(tree, (selector,))), None)
    if root is None:
        return []
    title = next((" ".join(flat(x)) for t in ("h1", "title") for x in inner(tree, (t,))[:1]), "")
    out, head, body = [], "", []
    for c in root.children:
        if isinstance(c, str) or c.tag in ("script", "style") or not (text := " ".join(flat(c)) if bold(c) else said(c)):
            continue
        if bold(c):
            out += [(head or title or "[Intro]", " ".join(body))] if body else []
            head, body = text, []
        else:
            body.append(text)
    return out + ([(head or title or "[Intro]", " ".join(body))] if body else [])


def found(spark, pages):
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    rows = sorted(chunking.sections(html.nodes(frame), "page_id", apart=" ").collect(), key=lambda r: (r["page_id"], r["section"]))
    return [[(r["heading"], r["body"]) for r in rows if r["page_id"] == i] for i in range(len(pages))]


def made(draw, depth=0):
    kinds = ["p", "div", "ul", "ol", "li", "b", "strong", "h2", "blockquote", "table", "tr", "td", "span", "img", "script"]
    out = []
    for _ in range(draw.randint(0, 4)):
        kind = draw.choice([None, None, *kinds])
        if kind is None:
            out.append(draw.choice(["one ", " two", "three three", "\n", " & ", "x"]))
        elif kind == "img":
            out.append(f"<img alt='{draw.choice(['', 'pic', ' p '])}'>")
        else:
            out.append(f"<{kind}>{made(draw, depth + 1) if depth < 5 else 'deep'}" + (f"</{kind}>" if draw.random() < 0.9 else ""))
    return "".join(out)


def test_sections_equal_a_plain_model(spark):
    draw = random.Random(5)
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]
    pages += [f"<title>T</title><article>{made(draw)}{made(draw)}</article>" for _ in range(300)]
    assert found(spark, pages) == [sections(p) for p in pages]


def test_sections_of_the_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {}
    for r in sorted(registry.QUERIES["html_sections"](spark, SF).collect(), key=lambda r: r["section"]):
        got.setdefault(r["page_id"], []).append((r["heading"], r["body"]))
    assert got == {i: s for i, p in pages.items() if (s := sections(p))}


def test_no_text_is_lost_or_doubled():
    text = lambda x: html.node_text(html.parsed(x).children[0])
    assert text("<blockquote>Intro <ul><li>a</li></ul> outro</blockquote>") == "Intro a outro"
    table = "<table><tr><td>h</td></tr><tr><td>v</td></tr></table>"
    assert text(f"<div><p>one</p>{table}<p>two</p><ul><li>a</ul></div>") == "h là v\none two a"
    assert text("<ul><li>a<ul><li>b</ul><li><b>c</b></ul>") == "• a b\nc"
    assert text("<ul>stray<li>a</li><ul><li>b</li></ul></ul>") == "stray\n• a\nb"
    assert html.table_text(html.parsed(f"<table><tr><td>x</td></tr><tr><td>y {table}</td></tr></table>").children[0]) == "x là y h v"
    assert html.page_nodes("<article>bare<p>in</p></article>") == [(0, 0, "in", "")]
    assert html.page_nodes("<article>bare<p>in</p></article>", bare=True) == [(0, 0, "bare", ""), (1, 0, "in", "")]


def test_deep_and_failing_pages(spark, monkeypatch):
    deep = "<article>" + "<div>" * 30_000 + "text" + "<b>x</b>" * 2000 + "</article>"
    assert html.page_nodes(deep)[0][2].startswith("text x") and html.main_content(deep)[1].startswith("text x")
    monkeypatch.setattr(html, "page_nodes", lambda *_: 1 / 0)
    rows, error = html._tried(lambda x: html.page_nodes(x))("<p>")
    assert rows is None and error.startswith("ZeroDivisionError") and html._tried(len)(None) == (None, None)
    frame = spark.createDataFrame([(1, None), (2, "<article><p>a</p></article>")], "page_id long, html string")
    assert [r["page_id"] for r in html.nodes(frame).collect()] == [2] and html.contents(frame).count() == 2
