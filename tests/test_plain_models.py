"""Queries that no SQL states, against plain models over the whole table."""

import re

from conftest import SF
from ragloom.operators import chunking, html
from ragloom.plans import registry


def test_page_contents(spark):
    def flat(node):
        if isinstance(node, str):
            return [" ".join(node.split())] if node.split() else []
        if node.tag in ("script", "style"):
            return []
        return [html.table_text(node)] if node.tag == "table" else [t for c in node.children for t in flat(c)]

    def first(node, tag):
        for c in node.children:
            if not isinstance(c, str):
                if c.tag == tag:
                    return c
                if (found := first(c, tag)) is not None:
                    return found
        return None

    wanted = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        tree = html.parsed(r["html"])
        root, titles = first(tree, "article"), [t for tag in ("h1", "title") if (t := first(tree, tag)) is not None]
        wanted[r["page_id"]] = (" ".join(flat(titles[0])) if titles else "", " ".join(flat(root))) if root else ("", "")
    for name, key in (("html_contents", "page_id"), ("contents_appended", "id_content")):
        found = registry.QUERIES[name](spark, SF).collect()
        assert len(found) == len(wanted) and {r[key]: (r["title"], r["content"]) for r in found} == wanted


def test_packed_sentences(spark):
    wanted = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        parts = [s for s in re.split(r"(?<=[.!?;–])\s+|\n+", r["text"]) if s.strip()]
        chunks = []
        for c in chunking.pack(parts, 250, 25):
            words = c.split()
            chunks += [c] if len(words) <= 250 else [" ".join(words[i : i + 250]) for i in range(0, max(len(words) - 25, 1), 225)]
        wanted[r["doc_id"]] = chunks
    got = {}
    for r in registry.QUERIES["sentence_pack"](spark, SF).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["chunk"]
    assert {i: [c[k] for k in range(len(c))] for i, c in got.items()} == {i: c for i, c in wanted.items() if c}
