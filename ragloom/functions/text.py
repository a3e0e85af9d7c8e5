"""Text functions as column expressions; Python only where Spark has no built-in (NFKC)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: every code point that counts as white space, as a class both Java and RE2 read alike
SPACE = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# fixed values: file extensions of the content types that are kept as files
EXTENSIONS = {
    "application/pdf": ".pdf",
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "application/zip": ".zip",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
}

# fixed values: common words that lexical ranking leaves out
STOPWORDS = (
    "là", "có", "và", "của", "cho", "trên", "trong", "với", "một", "các",
    "những", "rằng", "vì", "nên", "như", "đã", "sẽ", "được", "từ", "để", "khi",
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_TRIM))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, SPACE + "+", " "))


@cache
def _odd() -> np.ndarray:
    """Flags of the code points that equal others, case apart, in other ways than by their lower case."""
    out = np.zeros(0x110000, bool)
    for i in range(0x20000):
        low, up = chr(i).lower(), chr(i).upper()
        if len(low) > 1 or len(up) == 1 and up.lower() != low:
            out[[i, *map(ord, low), *map(ord, up.lower())]] = True
    return out


def _may_run(lines: list[str]) -> np.ndarray:
    """Whether each text may hold a run of five equal characters; a false no is not possible. Looks at the code points of all at once."""
    lines = [t.lower() for t in lines]
    points = np.frombuffer("\0".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    same = points[1:] == points[:-1]
    hits = _odd()[points]
    if len(same) >= 4:
        hits[: len(same) - 3] |= same[:-3] & same[1:-2] & same[2:-1] & same[3:]
    out = np.zeros(len(lines), bool)
    out[np.searchsorted(np.cumsum([len(t) + 1 for t in lines]), np.flatnonzero(hits), "right")] = True
    return out


_RUN = re.compile(r"(.)\1{4,}", re.I | re.S)


def _flat(text: str) -> str:
    """One leading bullet off, white space squeezed."""
    return " ".join((text[1:] if text[:1] in ("•", "-") else text).split())


def _changed(text: pd.Series, begin: Callable[[str], str], finish: Callable[[str], str]) -> pd.Series:
    """What `begin` makes of texts, without runs, as `finish` leaves it; null where nothing changes."""
    out: list = [None] * len(text)
    given = ["" if t is None else t for t in text]
    lines = [begin(t) for t in given]
    for i, (was, old, may) in enumerate(zip(given, lines, _may_run(lines).tolist(), strict=True)):
        new = finish(_RUN.sub(r"\1", old) if may else old)
        if new != was:
            out[i] = new
    return pd.Series(out, dtype=object)


def _same(text: str) -> str:
    return text


@F.pandas_udf(StringType())
def _without_runs(text: pd.Series) -> pd.Series:
    return _changed(text, _same, _same)


@F.pandas_udf(StringType())
def _stepped(text: pd.Series) -> pd.Series:
    return _changed(text, _flat, _same)


@F.pandas_udf(StringType())
def _cleaned(text: pd.Series) -> pd.Series:
    return _changed(text, _flat, lambda t: t if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def collapse_runs(text: Column) -> Column:
    """A run of five or more equal characters (case apart) as its first.

    In Python: Java's case-blind references to a group look back at every character, and fail at characters of two units at a text's end.
    """
    return F.coalesce(_without_runs(text), text)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compatible(text: Column) -> Column:
    """NFKC; of plain ASCII texts, which it never changes, only a null goes to Python."""
    plain = F.octet_length(text) == F.length(text)
    return F.coalesce(nfkc(F.when(~plain, text)), text)


def clean_steps(text: Column) -> Column:
    """One leading bullet off (before any trimming, so a blank protects it), white space squeezed, long runs collapsed."""
    return F.coalesce(_stepped(text), text)


def clean(text: Column) -> Column:
    """clean_steps, then NFKC last, so what it expands is not collapsed again; null stays null.

    One Arrow function, which gives back only what it changes: patterns for white space and runs took three times as long in the JVM.
    """
    return F.coalesce(_cleaned(text), text)


def sentences(text: Column) -> Column:
    """Parts between an end mark with white space after it, or line ends."""
    return F.split(text, rf"(?<=[.!?;–]){SPACE}+|\n+")


def nonblank(parts: Column) -> Column:
    return F.filter(parts, lambda x: x.isNotNull() & (strip(x) != ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def token_length(text: Column, special: int = 2) -> Column:
    """Tokens of the text and the special ones around it."""
    return F.size(tokens(text)) + special


def truncated(text: Column, limit: int = 250) -> Column:
    """The first `limit` tokens, the leading special one counted."""
    return F.array_join(F.slice(tokens(text), 1, limit - 1), " ")


def preview(text: Column, keep: int = 110, over: int = 113) -> Column:
    return F.when(F.length(text) > over, F.concat(F.substring(text, 1, keep), F.lit("…"))).otherwise(text)


def without_stopwords(text: Column, words: tuple[str, ...] = STOPWORDS) -> Column:
    return F.array_join(F.filter(tokens(text), lambda w: ~F.lower(w).isin(*words)), " ")


def first_nonblank(*values: Column) -> Column:
    return F.coalesce(*(F.when(v != "", v) for v in values))


def extension(content_type: Column) -> Column:
    """By exact type; parameters such as a charset make it unknown, which is the empty extension."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, content_type), F.lit(""))


def safe_filename(url: Column, ext: Column, limit: int = 200) -> Column:
    """Characters that file systems refuse as underscores; the end of a name that is too long, then the extension."""
    name = F.regexp_replace(url, r'[<>:"/\\|?*]', "_")
    room = F.lit(limit) - F.length(ext)
    return F.concat(F.when(F.length(name) + F.length(ext) > limit, F.right(name, room)).otherwise(name), ext)


def _without_dots(path: Column, relative: bool) -> Column:
    """A path from the root with its `.` and `..` parts carried out; empty parts within a relative one's are left out."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    if relative:
        parts = F.filter(parts, lambda x, i: (x != "") | (i == F.size(parts) - 1))
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(page_url: Column, link: Column) -> Column:
    """The link's target as seen from the page, by the rules for relative references; links with a scheme stay as they are.

    A link of `http…` is absolute whatever follows; an empty one is the page; `#…` and `?…` replace that part of the page's
    address.
    """
    scheme, host = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.regexp_extract(page_url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(page_url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*/|/)?", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return (
        F.when(link.startswith("http") | link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link == "", page_url)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(page_url, r"^([^#]*)", 1), link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(page_url, r"^([^?#]*)", 1), link))
        .when(link.startswith("/"), F.concat(root, _without_dots(path, False), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path), True), rest))
    )


def is_html(content_type: Column) -> Column:
    """Whether a content type, with or without parameters, is a page to parse; a null is none."""
    return F.coalesce(content_type.contains("text/html"), F.lit(False))


def pairs_text(pairs: Column, between: str = ": ", apart: str = " | ") -> Column:
    """A map as `key: value | key: value`, in the order of its keys."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(between), F.coalesce(e["value"].cast("string"), F.lit("")))), apart)


def request_json(model: str, messages: Column, temperature: float = 0.5, **more: float | int | bool) -> Column:
    """The body of a chat request."""
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(temperature).alias("temperature"), *(F.lit(v).alias(k) for k, v in more.items())))


def reply_text(body: Column) -> Column:
    """The content of a chat reply's first choice; null where there is none."""
    return F.get_json_object(body, "$.choices[0].message.content")


def links(html: Column) -> Column:
    """Distinct targets of href and src attributes."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?:href|src)=\"([^\"]*)\""), 1))


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")


def page_title(html: Column) -> Column:
    """The <title>, else the first <h1>, else empty."""
    part = lambda tag: squeeze(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"<[^>]*>", ""))
    return F.coalesce(first_nonblank(part("title"), part("h1")), F.lit(""))


def flat_header(levels: Column) -> Column:
    """Header levels that are neither blank nor `unnamed…`, joined, squeezed, in lower case."""
    kept = F.filter(levels, lambda x: (strip(x) != "") & ~F.lower(x).startswith("unnamed"))
    return F.lower(squeeze(F.array_join(kept, " ")))
