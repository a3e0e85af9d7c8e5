"""A text encoder learnt from the corpus: truncated singular vectors of its TF-IDF matrix, by block power iteration.

The texts are split into words once, and these counts are kept. Document frequencies are added up by Spark over all texts;
the TERMS most frequent ones are the columns. The matrix is written once, as packed sparse rows. Each round multiplies it
and its transpose by a thin basis in the tasks, row by row and then term by term, Spark adds the partial products up in
blocks of terms, and the driver orthonormalises the thin result (TERMS times a few dozen numbers). A text's vector is its
TF-IDF row times the basis, of unit length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ragloom.operators.lasting import bounded, lasting

#: Columns of the matrix (the model is this many times the size of a vector), size of vectors, further directions of the basis, rounds.
TERMS, SIZE, SPARE, ROUNDS = 1 << 14, 64, 16, 6
#: Rows of the basis that are added up together, entries of the matrix that a task multiplies at once, and tasks a core of a round.
BLOCK, ENTRIES, TASKS = 1 << 10, 1 << 21, 1

_WORD = re.compile(r"\w+")


#: Every ASCII character as itself where it is of a word, else as a blank.
_PLAIN = bytes(i if i > 127 or _WORD.match(chr(i)) else 32 for i in range(256))
_APART = re.compile(r"\W+")


def words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def _spaced(text: str | None) -> bytes:
    """The words of a text, with blanks between them."""
    low = (text or "").lower()
    return low.encode().translate(_PLAIN) if low.isascii() else _APART.sub(" ", low).encode()


@dataclass
class Encoder:
    """Places and weights of terms, the basis (a column a direction), and the matrix's singular values."""

    places: dict[str, int]
    weights: np.ndarray
    basis: np.ndarray
    values: np.ndarray

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights) of a text's TF-IDF row, of unit length."""
        found = [(p, n) for w, n in words(text).items() if (p := self.places.get(w)) is not None]
        at = np.array([p for p, _ in found], np.int32)
        weight = np.array([n for _, n in found], float) * self.weights[at]
        return at, weight / max(np.linalg.norm(weight), 1e-12)

    def vector(self, text: str | None) -> np.ndarray | None:
        """The text's vector, of unit length; none without a known term."""
        at, weight = self.row(text)
        out = weight @ self.basis[at]
        size = np.linalg.norm(out)
        return (out / size).astype(np.float32) if len(at) and size > 1e-9 else None

    def embed(self, text: Column) -> Column:
        @F.pandas_udf(ArrayType(FloatType()))
        def run(column: pd.Series) -> pd.Series:
            return pd.Series([self.vector(t) for t in column], dtype=object)

        return run(text)


def _small(values: np.ndarray) -> bytes:
    """Numbers from 0 on, packed to 2 bytes each, or 4 where one needs them."""
    return values.astype(np.uint16 if values.max(initial=0) < 1 << 16 else np.int32).tobytes()


def _large(blob: np.ndarray, many: int) -> np.ndarray:
    return blob.view(np.uint16 if len(blob) == 2 * many else np.int32).astype(np.int64)


def counted(docs: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """The words of all texts, read once: of each batch its ids, its `words` and in how many `texts` each is, and how many texts are not null.

    `sizes`, `at` and `n` are packed: how many words a text has, which of the batch's and how often.
    """
    kind = docs.schema[id_col].dataType.simpleString() if id_col else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            split = pc.ascii_split_whitespace(pa.array([_spaced(t.as_py()) for t in texts], pa.binary()).cast(pa.string()))
            coded = split.flatten().dictionary_encode()
            local, at = coded.dictionary, coded.indices.to_numpy()
            row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
            has = (pc.binary_length(local).to_numpy() > 0)[at]  # blanks at the ends give empty words
            key = row[has] * len(local) + at[has]
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            n = np.diff(first, append=len(key))
            row, at = np.divmod(key[first], max(len(local), 1))
            sizes, seen = np.bincount(row, minlength=len(texts)), np.bincount(at, minlength=len(local)).astype(np.int32)
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            blobs = [pa.array([x], pa.binary()) for x in (sizes.astype(np.int32).tobytes(), _small(at), _small(n))]
            yield pa.RecordBatch.from_arrays([whole(batch.column(0)), whole(local), whole(pa.array(seen)), pa.array([len(texts) - texts.null_count]), *blobs], ["ids", "words", "texts", "many", "sizes", "at", "n"])

    chosen = docs.select((F.col(id_col) if id_col else F.lit(None).cast("int")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return bounded(chosen).mapInArrow(run, f"ids array<{kind}>, words array<string>, texts array<int>, many bigint, sizes binary, at binary, n binary")


def _terms(packed: DataFrame) -> DataFrame:
    one = packed.select(F.explode(F.arrays_zip("words", "texts")).alias("w"))
    return one.where("w.texts > 0").groupBy(F.col("w.words").alias("term")).agg(F.sum(F.col("w.texts").cast("long")).alias("n"))


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): in how many texts each term occurs; a batch is added up before it is sent on."""
    return _terms(counted(docs, text_col))


def _packed(batches: Iterator[pa.RecordBatch], *others: str) -> Iterator[tuple]:
    """(ids, sizes, at, n, the other columns) of each packed row."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, at, n = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("sizes", np.int32), ("at", np.uint8), ("n", np.uint8)))
            many = int(sizes.sum())
            yield batch.column("ids")[i].values, sizes, _large(at, many), _large(n, many), *(batch.column(c)[i] for c in others)


def _weighted(packed: DataFrame, encoder: Encoder) -> DataFrame:
    """Packed rows of texts that have known terms: as of `counted`, with the `places` and `weights` of the batch's terms instead of words."""
    terms, weights = pa.array(list(encoder.places), pa.string()), encoder.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, at, n, found in _packed(batches, "words"):
            place = pc.fill_null(pc.index_in(found.values, terms), -1).to_numpy()
            own = place >= 0
            known, place = own[at], place[own]
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes)).astype(np.int32)
            has = np.flatnonzero(sizes)
            if len(has):
                ids = ids.take(pa.array(has))
                blobs = [sizes[has].tobytes(), _small((np.cumsum(own) - 1)[at[known]]), _small(n[known]), place.astype(np.int32).tobytes(), weights[place].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in blobs)], ["ids", "sizes", "at", "n", "places", "weights"])

    return packed.mapInArrow(run, f"ids {packed.schema['ids'].dataType.simpleString()}, sizes binary, at binary, n binary, places binary, weights binary")


def matrix(docs: DataFrame, encoder: Encoder, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """The TF-IDF rows of the texts that have known terms, packed."""
    return _weighted(counted(docs, text_col, id_col), encoder)


def _images(batches: Iterator[pa.RecordBatch], basis: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sizes, at, weight, image): whole rows of the matrix, about ENTRIES entries at a time, and these times the basis."""

    def made(held: list[tuple]) -> tuple:
        ids = pa.concat_arrays([h[0] for h in held])
        sizes, at, weight = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        image, end = np.zeros((len(sizes), basis.shape[1])), np.cumsum(sizes)
        for i, (a, b) in enumerate(zip((end - sizes).tolist(), end.tolist(), strict=True)):
            np.dot(weight[a:b], basis.take(at[a:b], 0), out=image[i])
        return ids, sizes, at, weight, image

    held, entries = [], 0
    for ids, sizes, at, n, places, weights in _packed(batches, "places", "weights"):
        weight = n * np.frombuffer(weights.as_buffer())[at]
        row = np.repeat(np.arange(len(sizes)), sizes)
        weight /= np.maximum(np.sqrt(np.bincount(row, weight**2, len(sizes))), 1e-12)[row]
        held.append((ids, sizes, np.frombuffer(places.as_buffer(), np.int32)[at], weight))
        entries += len(at)
        if entries >= ENTRIES:
            yield made(held)
            held, entries = [], 0
    if held:
        yield made(held)


def multiplied(packed: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The matrix's transpose times the matrix times the basis; what tasks have is added up by blocks of terms."""
    terms, width = basis.shape
    small = np.uint16 if terms <= 1 << 16 else np.int32  # sorted by counting

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, sizes, at, weight, image in _images(batches, basis):
            total = np.zeros((terms, width)) if total is None else total
            order = np.argsort(at.astype(small), kind="stable")
            row, weight = np.repeat(np.arange(len(sizes)), sizes)[order], weight[order]
            many = np.bincount(at, minlength=terms)
            end = np.cumsum(many)
            for t in np.flatnonzero(many).tolist():
                own = slice(end[t] - many[t], end[t])
                total[t] += weight[own] @ image.take(row[own], 0)
        if total is not None:
            starts = range(0, terms, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK for a in starts], pa.int32()), pa.array([total[a : a + BLOCK].tobytes() for a in starts], pa.binary())], ["block", "part"])

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("part"):
                part = np.frombuffer(x.as_buffer())
                total = part.copy() if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "part"])

    out = np.zeros((terms, width))
    for r in packed.mapInArrow(run, "block int, part binary").groupBy("block").applyInArrow(added, "block int, part binary").collect():  # terms times width numbers
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["part"]).reshape(-1, width)
    return out


def _vectors(packed: DataFrame, encoder: Encoder) -> DataFrame:
    """(id, vec) of the matrix's rows, as Encoder.vector gives them; rows without a vector are left out."""
    basis = encoder.basis

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, _, image in _images(batches, basis):
            size = np.linalg.norm(image, axis=1)
            has = np.flatnonzero(size > 1e-9)
            unit = (image[has] / size[has, None]).astype(np.float32)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * unit.shape[1], pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(has)), vec], ["id", "vec"])

    return packed.mapInArrow(run, f"id {packed.schema['ids'].dataType.elementType.simpleString()}, vec array<float>")


def _fitted(docs: DataFrame, text_col: str, id_col: str | None, terms: int, size: int, rounds: int, seed: int) -> tuple[Encoder, DataFrame | None]:
    """The encoder and the packed matrix that it is learnt from; no matrix without terms."""
    packed = lasting(counted(docs, text_col, id_col))
    many = packed.agg(F.coalesce(F.sum("many"), F.lit(0)).alias("n")).first()["n"]
    top = lasting(_terms(packed).orderBy(F.desc("n"), "term").limit(terms)).collect()  # put together in a task, not by the driver
    top.sort(key=lambda r: (-r["n"], r["term"].encode()))
    encoder = Encoder({r["term"]: k for k, r in enumerate(top)}, np.array([1 + math.log((1 + many) / (1 + r["n"])) for r in top]), np.zeros((len(top), 0)), np.zeros(0))
    if not top:
        return encoder, None
    # each task of a round sends a whole product, so their number goes by the cores and not by the input
    packed = lasting(_weighted(packed, encoder).coalesce(TASKS * docs.sparkSession.sparkContext.defaultParallelism))
    width = min(size + SPARE, len(top))
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(len(top), width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(multiplied(packed, basis))[0]
    # the best directions within the basis
    squares, turn = np.linalg.eigh(basis.T @ multiplied(packed, basis))
    order = np.argsort(-squares)[: min(size, width)]
    values = np.sqrt(np.maximum(squares[order], 0))
    order, values = order[values > 1e-6], values[values > 1e-6]
    basis = basis @ turn[:, order]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1)  # one of the two signs
    return Encoder(encoder.places, encoder.weights, basis, values), packed


def learnt(docs: DataFrame, text_col: str = "text", terms: int = TERMS, size: int = SIZE, rounds: int = ROUNDS, seed: int = 7) -> Encoder:
    """The encoder of a corpus, from all its texts. Of equally frequent terms the first by code point are taken.

    A corpus of fewer terms or texts than `size` gives shorter vectors, an empty one an encoder that gives none.
    """
    return _fitted(docs, text_col, None, terms, size, rounds, seed)[0]


def embedded(docs: DataFrame, id_col: str, text_col: str = "text", terms: int = TERMS, size: int = SIZE, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """(id, vec) of a corpus's own texts by the encoder learnt from them; the texts are read once. Texts without a vector are left out."""
    encoder, packed = _fitted(docs, text_col, id_col, terms, size, rounds, seed)
    if packed is None:
        return docs.sparkSession.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, vec array<float>")
    return lasting(_vectors(packed, encoder))
