"""Chunks: token windows, sections under headings, packed sentences, breaks by meaning."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.functions import vectors as V
from ragloom.operators.lasting import bounded


#: Where the second tier splits: after an end mark with white space behind it, or at line ends.
_MARKS = re.compile(r"(?<=[.!?;–])\s+|\n+")


def window_starts(n: Column, size: int = 250, overlap: int = 25) -> Column:
    """Offsets of the windows over n tokens: none for no tokens, one up to `size`, then one each `size - overlap`."""
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int") * step
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def token_windows(df: DataFrame, text_col: str = "text", size: int = 250, overlap: int = 25) -> DataFrame:
    """A row for each window: chunk_no from 0 and chunk; texts without tokens give none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    parts = df.withColumn("_tokens", T.tokens(F.col(text_col)))
    parts = parts.withColumn("_at", F.explode(window_starts(F.size("_tokens"), size, overlap)))
    out = parts.withColumn("chunk_no", (F.col("_at") / (size - overlap)).cast("int"))
    return out.withColumn("chunk", F.array_join(F.slice("_tokens", F.col("_at") + 1, F.lit(size)), " ")).drop("_tokens", "_at")


def sections(nodes: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text", heading: str = "is_heading", title: str = "title", unnamed: str = "[Intro]", apart: str = "\n") -> DataFrame:
    """(doc, section, heading, body): each heading opens a section; sections without a body are left out.

    A section before the first heading is headed by the document's title, else by `unnamed`. Bodies keep their order.
    """
    at = Window.partitionBy(doc).orderBy(pos)
    numbered = nodes.withColumn("section", F.sum(F.col(heading).cast("int")).over(at))
    body = F.array_sort(F.collect_list(F.when(F.col(heading) == 0, F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))))
    out = numbered.groupBy(doc, "section").agg(
        F.max(F.when(F.col(heading) == 1, F.col(text))).alias("h"), F.first(title, ignorenulls=True).alias("m"), F.transform(body, lambda x: x["t"]).alias("parts")
    )
    out = out.where(F.size("parts") > 0)
    return out.select(doc, "section", F.coalesce(T.first_nonblank(F.col("h"), F.col("m")), F.lit(unnamed)).alias("heading"), F.array_join("parts", apart).alias("body"))


def pack(parts: list[str], size: int = 250, overlap: int = 25, compat: bool = False, length: Callable[[str], int] | None = None) -> list[str]:
    """Sentences packed greedily up to `size` tokens, each chunk after the first starting with the last ones of the one before.

    The carried sentences have fewer than `overlap` tokens between them or are the one that reaches it, and at least
    one new sentence follows them. By default no chunk exceeds `size` unless a single sentence does, and none is empty.
    With `compat`, lengths after a carry count what was left of the full chunk instead of what was carried, so chunks
    may exceed `size`, and a first sentence over the limit gives an empty chunk, as in the pipeline this replaces; there
    each length, of a sentence or of several joined, also counts the tokenizer's two special tokens. `length` replaces
    either measure.
    """
    length = length or (lambda s: len(s.split()) + 2 * compat)
    chunks: list[str] = []
    held: list[str] = []
    used = 0
    for part in parts:
        n = length(part)
        if used + n <= size or (not held and not compat):
            held.append(part)
            used += n
            continue
        chunks.append(" ".join(held))
        carried: list[str] = []
        total = 0
        rest = list(held)
        while rest and (length(" ".join(carried)) if compat else total) < overlap:
            carried.insert(0, rest.pop())
            total += length(carried[0])
        if not compat:
            while carried and total + n > size:
                total -= length(carried.pop(0))
            used = total + n
        else:
            used = length(" ".join([*rest, part]))
        held = [*carried, part]
    if held:
        chunks.append(" ".join(held))
    return chunks


def packed_sentences(df: DataFrame, text_col: str = "text", size: int = 250, overlap: int = 25, compat: bool = False, length: Callable[[str], int] | None = None) -> DataFrame:
    """A row for each chunk of packed sentences; chunks still over `size` are cut into token windows. `length` as of `pack`."""

    @F.pandas_udf("array<string>")
    def packing(column: pd.Series) -> pd.Series:
        return column.map(lambda s: [] if s is None else pack(list(s), size, overlap, compat, length))

    whole = bounded(df).withColumn("_chunks", packing(T.nonblank(T.sentences(F.col(text_col)))))

    def cut(chunk: Column) -> Column:
        words = T.tokens(chunk)
        windows = F.transform(window_starts(F.size(words), size, overlap), lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))
        return F.when(F.size(words) > size, windows).otherwise(F.array(chunk))

    return whole.select("*", F.posexplode(F.flatten(F.transform("_chunks", cut))).alias("chunk_no", "chunk")).drop("_chunks")


def three_tiers(parts: list[str], size: int = 250, overlap: int = 25, compat: bool = False) -> list[str]:
    """Sentences packed; what is still over `size` split at end marks and lines and packed again; what is then still over it cut into token windows."""
    length = lambda s: len(s.split()) + 2 * compat
    finer = (d for c in pack(parts, size, overlap, compat) for d in ([c] if length(c) <= size else pack([s.strip() for s in _MARKS.split(c) if s.strip()], size, overlap, compat)))
    out = []
    for chunk in finer:
        words = chunk.split()
        starts = range(0, max(len(words) - overlap, 1), size - overlap)
        out += [chunk] if length(chunk) <= size else [" ".join(words[i : i + size]) for i in starts]
    return out


def packed_sentences_learnt(sentences: DataFrame, column: str = "sentences", size: int = 250, overlap: int = 25, compat: bool = False) -> DataFrame:
    """A row for each chunk (chunk_no, chunk) of sentences that learnt borders gave, by three_tiers."""

    @F.pandas_udf("array<string>")
    def packing(values: pd.Series) -> pd.Series:
        return values.map(lambda s: [] if s is None else three_tiers(list(s), size, overlap, compat))

    return bounded(sentences).select("*", F.posexplode(packing(F.col(column))).alias("chunk_no", "chunk")).drop(column)


def overlapping(df: DataFrame, sentences_col: str, size: int = 256, overlap: int = 50, line: Callable[[str], str] | None = None) -> DataFrame:
    """A row for each chunk (chunk_no, chunk) of word-segmented sentences; progress is certain, since every chunk takes a new sentence.

    With `line`, which segments one sentence, the sentences are segmented where they are packed and go to Python once.
    """

    @F.pandas_udf("array<string>")
    def packing(column: pd.Series) -> pd.Series:
        return column.map(lambda s: [] if s is None else pack(list(s) if line is None else list(map(line, s)), size, overlap))

    return bounded(df).select("*", F.posexplode(packing(F.col(sentences_col))).alias("chunk_no", "chunk"))


def character_parts(text: str, size: int = 250, overlap: int = 25, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Parts of up to `size` characters, cut at the coarsest mark that makes pieces small enough; each begins with up to `overlap` characters of the one before."""
    mark = next((m for m in marks if m in text), "")
    finer = marks[marks.index(mark) + 1 :] or ("",)
    out: list[str] = []
    held: list[str] = []
    room = lambda: sum(map(len, held)) + len(mark) * len(held)

    def close() -> None:
        if part := mark.join(held).strip():
            out.append(part)

    for piece in text.split(mark) if mark else text:
        if len(piece) > size:
            close()
            held.clear()
            out += character_parts(piece, size, overlap, finer)
            continue
        if held and room() + len(piece) > size:
            close()
            while held and (room() > overlap or room() + len(piece) > size):
                held.pop(0)
        if piece:
            held.append(piece)
    close()
    return out


def semantic_parts(df: DataFrame, embed: Callable[[Column], Column], doc: str = "doc_id", text_col: str = "text", percentile: float = 0.95, limit: int = 250, buffer: int = 1) -> DataFrame:
    """(doc, part, text): sentences joined until the next one's embedding is farther than the document's percentile of such distances.

    A sentence is embedded together with `buffer` neighbours on either side. As in the pipeline this replaces, sentences
    are cut to `limit` tokens, the leading special one counted; None leaves them whole. A document with a sentence that
    has no embedding falls back to `character_parts`.
    """
    rows = bounded(df).select(doc, F.posexplode(T.nonblank(T.sentences(F.col(text_col)))).alias("pos", "s"))
    rows = rows if limit is None else rows.withColumn("s", T.truncated(F.col("s"), limit))
    at = Window.partitionBy(doc).orderBy("pos")
    near = at.rowsBetween(-buffer, buffer)
    rows = rows.withColumn("v", embed(F.array_join(F.collect_list("s").over(near), " ")))
    rows = rows.withColumn("d", 1 - V.cosine(F.col("v"), F.lag("v").over(at)))
    whole = Window.partitionBy(doc)
    edge = F.expr(f"percentile(d, {percentile})").over(whole)
    rows = rows.withColumn("failed", F.max(F.col("v").isNull()).over(whole))
    rows = rows.withColumn("part", F.sum(F.coalesce((F.col("d") > edge).cast("int"), F.lit(0))).over(at))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ")
    parts = rows.groupBy(doc, F.when(F.col("failed"), F.lit(0)).otherwise(F.col("part")).alias("part")).agg(joined.alias("text"), F.max("failed").alias("failed"))

    @F.pandas_udf("array<string>")
    def fallback(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else character_parts(t))

    cut = parts.withColumn("cut", fallback(F.when(F.col("failed"), F.col("text"))))
    cut = cut.select(doc, F.col("part").alias("first"), F.posexplode(F.coalesce("cut", F.array("text"))).alias("i", "text"))
    return cut.select(doc, (F.col("first") + F.col("i")).cast("long").alias("part"), "text")


#: Sentences whose vectors a task holds at once.
AT_ONCE = 1 << 13


def _distances(places: np.ndarray, many: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, buffer: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each sentence, its distance from the one before and whether it and its neighbours hold no place at all.

    `many` are the places of a sentence, `first` and `last` the ends of its document. All is added up in the order in
    which `V.cosine` adds.
    """
    n = len(many)
    out, none, ends = np.zeros(n), np.zeros(n, bool), np.concatenate([[0], np.cumsum(many)])
    for a in range(0, n, AT_ONCE):
        b = min(a + AT_ONCE, n)
        own = np.arange(max(a - 1, 0), b)
        left, right = np.maximum(own - buffer, first[own]), np.minimum(own + buffer + 1, last[own])
        lo, hi = int(left.min()), int(right.max())
        counts = np.bincount(np.repeat(np.arange(hi - lo), many[lo:hi]) * size + places[ends[lo] : ends[hi]], minlength=(hi - lo) * size).reshape(-1, size)
        total = np.concatenate([np.zeros((1, size), np.int64), np.cumsum(counts, 0)])
        near = (total[right - lo] - total[left - lo]).T.astype(float)
        squares = (near * near).sum(0)
        unit = near / np.sqrt(np.maximum(squares, 1))
        dots, norms = np.zeros(len(own) - 1), np.zeros(len(own))
        for x in unit:
            dots += x[:-1] * x[1:]
            norms += x * x
        norms = np.sqrt(norms)
        out[own[1:]] = 1 - dots / np.maximum(norms[:-1] * norms[1:], 1e-12)
        none[own] = squares == 0
    return out, none


def _percentile(values: np.ndarray, share: float) -> float:
    """As Spark's exact percentile."""
    values, at = np.sort(values), (len(values) - 1) * share
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def semantic_parts_counted(df: DataFrame, places: Callable[[Column, int], Column], size: int = 64, doc: str = "doc_id", text_col: str = "text", percentile: float = 0.95, limit: int | None = 250, buffer: int = 1) -> DataFrame:
    """As `semantic_parts`, by an embedding that counts the places (0 to `size` - 1) which `places` gives a text's words.

    The counts of a sentence and its neighbours add up, so every sentence is looked at once, and a row of `df` is cut as
    a whole where it is read, without a shuffle. Rows that share an id are documents of their own.
    """
    parts = T.nonblank(T.sentences(F.col(text_col)))
    parts = parts if limit is None else F.transform(parts, lambda s: T.truncated(s, limit))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("s"), batch.column("p").flatten()
            lengths = texts.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(lengths)
            d, none = _distances(found.flatten().to_numpy(), found.value_lengths().to_numpy(), np.repeat(ends - lengths, lengths), np.repeat(ends, lengths), size, buffer)
            row, part, text = [], [], []
            for k, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), strict=True)):
                own = texts[k].as_py() or []
                if none[a:b].any():
                    new = character_parts(" ".join(own))
                else:
                    at = np.flatnonzero(d[a + 1 : b] > _percentile(d[a + 1 : b], percentile)) + 1 if b - a > 1 else []
                    starts = [0, *at, b - a] if own else []
                    new = [" ".join(own[i:j]) for i, j in zip(starts, starts[1:])]
                row += [k] * len(new)
                part += range(len(new))
                text += new
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row, pa.int64())), pa.array(part, pa.int64()), pa.array(text, pa.string())], [doc, "part", "text"])

    rows = bounded(df).select(F.col(doc).alias("doc"), parts.alias("s"))
    rows = rows.select("doc", "s", F.transform("s", lambda s: places(s, size)).alias("p"))
    return rows.mapInArrow(cut, f"`{doc}` {df.schema[doc].dataType.simpleString()}, part long, text string")
