"""Language identification by nearest centroid.

Byte n-grams of a text (lower-cased, runs of anything but letters as one blank) make a TF-IDF vector over
hashed dimensions, of unit length. Each language has several centroids from spherical k-means over its
training vectors. A text gets the language of the centroid nearest by cosine, and is rejected where even
that is farther than nearly all of the language's own training texts were from centroids made without them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.textwords import blocks

#: Training texts of each language, at most: those of least md5 of the id. Longer texts than so many bytes are not learnt from.
TRAIN_EACH, TRAIN_LONGEST = 300, 1 << 16
#: Hashed dimensions, and centroids of each language.
DIMENSIONS, CENTROIDS = 4096, 4
#: Rejected is a cosine below this quantile of the language's training texts against centroids of the other folds; never texts under SHORT bytes.
QUANTILE, FOLDS, SHORT = 0.005, 4, 64
UNKNOWN = "und"

_rng = np.random.Generator(np.random.PCG64(77))
_SALT = [_rng.integers(0, DIMENSIONS, 256, dtype=np.int64) for _ in range(3)]
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)  # bytes of other letters


def grams(data: np.ndarray) -> np.ndarray:
    """The dimension of the 3-gram at each byte; -1 where it lies within one blank run."""
    x = _FOLD[data]
    n = len(x)
    out = np.full(n, -1, np.int64)
    if n < 3:
        return out
    out[: n - 2] = _SALT[0][x[:-2]] ^ _SALT[1][x[1:-1]] ^ _SALT[2][x[2:]]
    blank = x == 32
    out[: n - 2][blank[1:-1] & (blank[:-2] | blank[2:])] = -1
    return out


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text holds each dimension."""
    g = grams(data)
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own = g[a : max(a, b - 2)]
        own = own[own >= 0]
        if len(own):
            out[d] = np.bincount(own, minlength=DIMENSIONS)
    return out


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Centroids:
    languages: list[str]
    of: np.ndarray  # the language of each centroid
    idf: np.ndarray
    at: np.ndarray
    floor: np.ndarray  # the cosine under which a language rejects


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    draw = np.random.Generator(np.random.PCG64(9))
    at = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ at.T).argmax(1)
        for j in range(len(at)):
            if (own := x[near == j]).size:
                at[j] = own.sum(0)
        at /= np.maximum(np.sqrt((at * at).sum(1, keepdims=True)), 1e-12)
    return at


def _floor(x: np.ndarray) -> float:
    """The cosine that all but a QUANTILE of a language's vectors have with centroids of the other folds; none for too few to tell."""
    if len(x) < 2 * FOLDS:
        return 0.0
    fold = np.arange(len(x)) % FOLDS
    held = []
    for f in range(FOLDS):
        rest = x[fold != f]
        held.append((x[fold == f] @ _kmeans(rest, min(CENTROIDS, len(rest))).T).max(1))
    return float(np.quantile(np.concatenate(held), QUANTILE, method="lower"))


def train(texts: list[str], languages: list[str]) -> Centroids:
    """Centroids from whole texts and their languages; none when there are no texts."""
    names = sorted(set(languages))
    counts = np.concatenate([_counts(data, offsets) for _, _, data, offsets in blocks(pa.array(texts, pa.string()))]) if texts else np.zeros((0, DIMENSIONS), np.float32)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = _vectors(counts, idf)
    y = np.array([names.index(v) for v in languages], np.int64)
    size = np.cumsum([0, *(len(t.encode()) for t in texts)])
    at, of, floor = [], [], np.zeros(len(names))
    for j in range(len(names)):
        own = x[y == j]
        means = _kmeans(own, min(CENTROIDS, len(own)))
        at.append(means)
        of += [j] * len(means)
        floor[j] = _floor(own[np.diff(size)[y == j] >= SHORT])
    return Centroids(names, np.array(of, np.int64), idf, np.concatenate(at) if at else np.zeros((0, DIMENSIONS), np.float32), floor)


def learnt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = TRAIN_EACH) -> Centroids:
    """Centroids from up to `each` texts of every non-null language; all rows of `docs` may be learnt from.

    The sample comes to the driver: `each` texts of up to TRAIN_LONGEST bytes for every language the column has. Ids that
    are no numbers are not learnt from.
    """
    able = F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= TRAIN_LONGEST) & F.col(id_col).isNotNull()
    known = docs.where(able).select(F.col(id_col).try_cast("long").alias("id"), F.col(lang_col).alias("y")).where("id is not null").withColumn("m", F.md5(F.col("id").cast("string").cast("binary")))
    # of a large language only ids of hashes so small that about four times as many as are wanted remain
    sizes = known.groupBy("y").agg(F.approx_count_distinct("id").alias("n")).where(F.col("n") > 4 * each).collect()
    edge = F.create_map(*(F.lit(x) for r in sizes for x in (r["y"], f"{int(4 * each / r['n'] * 2**32):08x}"))) if sizes else None
    if sizes:
        known = known.where(F.coalesce(F.substring("m", 1, 8) <= F.try_element_at(edge, F.col("y")), F.lit(True)))
    order = Window.partitionBy("y").orderBy("m", "id")
    ids = known.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("id", "y")
    ids = docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in ids.collect()], "id long, y string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("l")).where(F.octet_length("text") <= TRAIN_LONGEST)
    rows = rows.join(F.broadcast(ids), (rows["id"].try_cast("long") == ids["id"]) & (rows["l"] == ids["y"])).select(ids["id"], "y", "text").collect()
    rows.sort(key=lambda r: (r["y"], r["id"], r["text"]))
    return train([r["text"] for r in rows], [r["y"] for r in rows])


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    plain = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))])[offsets]
    out = np.diff(plain) > 0
    for d in np.flatnonzero(~out):
        raw = data[offsets[d] : offsets[d + 1]]
        out[d] = bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode())
    return out


def _identifying(model: Centroids, carry: list[str]):
    def run(batches):
        for batch in batches:
            names, scores, far = [], [], []
            for row, end, data, offsets in blocks(batch.column("text")):
                letter = has_letter(data, offsets)
                for a in range(row, end, 256):
                    b = min(end, a + 256)
                    part = offsets[a - row : b - row + 1]
                    if not len(model.at):
                        names += [UNKNOWN] * (b - a)
                        scores += [0.0] * (b - a)
                        far += [True] * (b - a)
                        continue
                    cosine = _vectors(_counts(data[part[0] : part[-1]], part - part[0]), model.idf) @ model.at.T
                    best = cosine.argmax(1)  # the first of equals: the least language
                    score = np.clip(cosine[np.arange(b - a), best].astype(float), 0, 1)
                    lang = model.of[best]
                    ok = letter[a - row : b - row]
                    names += [model.languages[j] if k else UNKNOWN for j, k in zip(lang, ok, strict=True)]
                    scores += np.where(ok, score, 0.0).tolist()
                    far += (~ok | (score < model.floor[lang]) & (np.diff(part) >= SHORT)).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], [*carry, "lang", "score", "far"])

    return run


def identify(docs: DataFrame, model: Centroids, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The rows (columns in `carry`, all by default) with `lang_pred`, `score` and `rejected`.

    `score` is the cosine with the nearest centroid, `lang_pred` its language; of centroids equally near, the least
    language's. Texts that are null or have no letter are `und`, score 0 and are rejected; other texts are rejected
    where the score is under the language's floor. A model without centroids (nothing to learn from) gives `und`
    and rejects all. Columns of the input named like the new ones are replaced.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score", "rejected")]
    names = [f"c{i}" for i in range(len(keep))]  # apart from any name of the input
    part = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([*(f"{n} {part.schema[n].dataType.simpleString()}" for n in names), "lang string, score double, far boolean"])
    out = part.mapInArrow(_identifying(model, names), schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), F.col("lang").alias("lang_pred"), "score", F.col("far").alias("rejected"))
