"""Queries over files that Spark derives from the given tables, and reads back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ragloom.functions import text as T
from ragloom.operators.lasting import lasting
from ragloom.plans.registry import query
from ragloom.sources import pdf
from ragloom.sources.pdf_writer import written
from ragloom.sources.tables import table

#: Words of a line and of a page of the rendered documents.
_LINE, _PAGE = 10, 400


@F.pandas_udf(BinaryType())
def _rendered(ids: pd.Series, words: pd.Series, facts: pd.Series) -> pd.Series:
    """A page with a table of facts and pages of text; some with packed objects, some without the end, some cut short."""

    def one(i: int, line: list[str], about: list) -> bytes:
        pages = [{"table": [["Field", "Value"], *([f["k"], f["v"]] for f in about)]}]
        pages += [{"lines": [" ".join(line[b : min(b + _LINE, a + _PAGE)]) for b in range(a, min(a + _PAGE, len(line)), _LINE)]} for a in range(0, len(line), _PAGE)]
        out = written(pages, packed=i % 7 == 0)
        return out[:100] if i % 97 == 5 else out[:-40] if i % 5 == 0 else out

    return pd.Series([one(i, list(w), list(f)) for i, w, f in zip(ids, words, facts, strict=True)], dtype=object)


@query(rf"""
WITH w AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '{T.SPACE}+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT *, 1 + CAST(ceil(len(w) / 400.0) AS BIGINT) AS pages FROM w),
good AS (SELECT * FROM n WHERE doc_id % 97 <> 5),
f AS (SELECT doc_id, unnest(list_filter([CASE WHEN trim(lang) <> '' THEN 'field lang value ' || lang ELSE 'field lang' END, CASE WHEN trim(source) <> '' THEN 'field source value ' || source ELSE 'field source' END, coalesce('field chars value ' || n_chars, 'field chars')], lambda x: true)) AS line, generate_subscripts([1, 2, 3], 1) - 1 AS i FROM good),
p AS (SELECT doc_id, unnest(range(1, pages)) AS page, w FROM good),
s AS (SELECT doc_id, page, list_slice(w, (page - 1) * 400 + 1, page * 400) AS w FROM p),
l AS (SELECT doc_id, page, w, unnest(range(0, CAST(greatest(ceil((len(w) - 250) / 225.0), 0) AS INT) + 1)) AS i FROM s)
SELECT doc_id, 1::INT AS page, i::INT AS line_no, md5(line) AS digest, NULL AS error FROM f
UNION ALL SELECT doc_id, (page + 1)::INT, i::INT, md5(array_to_string(list_slice(w, i * 225 + 1, i * 225 + 250), ' ')), NULL FROM l
UNION ALL SELECT doc_id, NULL, 0::INT, NULL, 'no page tree' FROM n WHERE doc_id % 97 = 5""")
def pdf_pages(spark, d):
    """Every document as a PDF file in a column, and the lines that chunking gets from it, of however many pages; files that fail have their error."""
    docs = table(spark, d, "documents")
    pair = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v"))
    facts = F.array(pair("lang", "lang"), pair("source", "source"), pair("chars", "n_chars"))
    files = docs.select("doc_id", _rendered("doc_id", T.tokens(F.coalesce("text", F.lit(""))), facts).alias("content"))
    out = pdf.lines(lasting(pdf.placed(files, "doc_id", max_pages=None)), "doc_id")
    return out.select("doc_id", "page", "line_no", F.md5(F.col("line").cast("binary")).alias("digest"), "error")
