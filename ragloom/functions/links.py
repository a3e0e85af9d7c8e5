"""Addresses in pages: a scanner of tags over the bytes of a page, for attributes in any quotes, entities, comments and base addresses."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# states of the scanner, each the pattern of what it takes next
_BLANK = rb"\t\n\f\r "
_OPENS = re.compile(rb"<(?:(!--)|([!?])|(/?)([A-Za-z][^" + _BLANK + rb"/>]*))")
_ATTRIBUTE = re.compile(rb"[" + _BLANK + rb"/]*(?:(>)|([^" + _BLANK + rb"/>=][^" + _BLANK + rb"/>=]*)(?:[" + _BLANK + rb"]*=[" + _BLANK + rb"]*(?:\"([^\"]*)\"|'([^']*)'|([^" + _BLANK + rb">\"'][^" + _BLANK + rb">]*)?))?)")
_RAW = {b"script": re.compile(rb"</script(?=[" + _BLANK + rb"/>])", re.I), b"style": re.compile(rb"</style(?=[" + _BLANK + rb"/>])", re.I)}


def tags(page: bytes) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(tag, attributes) of each start tag, names in lower case, entities resolved; what is in comments, scripts and styles is none.

    A tag or comment that does not end is left out with all behind it.
    """
    at = page.find(b"<")
    while at >= 0:
        m = _OPENS.match(page, at)
        if not m:
            at = page.find(b"<", at + 1)
            continue
        if m.group(1) or m.group(2):
            end = page.find(b"-->" if m.group(1) else b">", m.end())
            if end < 0:
                return
            at = page.find(b"<", end)
            continue
        name, at, found = m.group(4).lower(), m.end(), []
        while True:
            a = _ATTRIBUTE.match(page, at)
            if not a:
                if at >= len(page):
                    return
                at += 1  # a sign that begins no attribute
                continue
            at = a.end()
            if a.group(1):
                break
            value = next((v for v in a.groups()[2:] if v is not None), b"")
            found.append((a.group(2).decode("utf-8", "replace").lower(), html.unescape(value.decode("utf-8", "replace"))))
        if not m.group(3):
            yield name.decode("utf-8", "replace"), found
            if name in _RAW:
                end = _RAW[name].search(page, at)
                if not end:
                    return
                at = end.start()
        at = page.find(b"<", at)


def addresses(page: str | bytes, url: str | None = None, base: bool = False) -> list[str]:
    """The distinct `href` and `src` values in order of first sight; with a url, resolved against it, and with `base` against the page's own base address."""
    raw = page.encode() if isinstance(page, str) else page
    found, start = {}, url
    for name, attributes in tags(raw):
        for key, value in attributes:
            if key in ("href", "src"):
                found.setdefault(value)
        if base and name == "base" and start == url and url is not None and (given := dict(reversed(attributes)).get("href")):
            start = _joined(url, given)
    return list(dict.fromkeys(v if start is None or v.startswith("http") else _joined(start, v) for v in found))


def _joined(url: str, link: str) -> str:
    try:
        return urljoin(url, link)
    except ValueError:  # no address
        return link


def page_links(page: Column, url: Column | None = None, base: bool = False) -> Column:
    """The addresses of each page; null for null pages."""
    kind = ArrayType(StringType())
    if url is None:

        @F.pandas_udf(kind)
        def run(pages: pd.Series) -> pd.Series:
            return pages.map(lambda p: None if p is None else addresses(p))

        return run(page)

    @F.pandas_udf(kind)
    def resolved(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else addresses(p, u, base) for p, u in zip(pages, urls, strict=True)], dtype=object)

    return resolved(page, url)
