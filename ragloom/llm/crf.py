"""Toxic spans and document scores by a linear-chain conditional random field with two states.

Training (on the driver, from a bounded sample of labelled documents): a few features of words that
occur almost only in toxic documents, chosen to cover those documents, give the tokens their labels
(words that are frequent only because a toxic document has copies cover nothing new); the field's weights for features and
transitions then follow from the gradient of its conditional likelihood, by forward-backward sums.
Scoring: the marginals of each token's toxic state by forward-backward over the whole text, split into
chunks whose transfer matrices are multiplied first, so that all chunks of a block advance together.
A document's score is its greatest marginal; stretches of tokens above one half are its spans.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.textwords import blocks, bounds, word_hashes

#: Documents of each label that the field is trained on, at most: those of least md5 of the id. Longer texts than so many bytes are not learnt from.
TRAIN_EACH, TRAIN_LONGEST = 1_200, 1 << 16
#: Training sequences with a marked token and without one, at most: a seeded choice.
TRAIN_MARKED, TRAIN_OTHER = 3_000, 6_000
#: Weights of features, by hash; rounds and rate of the training; penalty of large weights.
FEATURES, ROUNDS, RATE, PENALTY = 1 << 18, 60, 0.5, 1e-6
#: A feature may mark tokens when toxic documents are such a share of those it is in (by rates), and it is chosen as
#: long as it marks at least so many toxic documents (and this share of them) that have not COVER chosen features yet.
PURITY, SUPPORT, SUPPORT_SHARE, COVER = 0.98, 3, 0.004, 2
#: A feature marks tokens also when it is in such a share of the toxic documents, of which near copies count as one:
#: those that share this many of as many minimum hashes of their words.
OFTEN, SKETCH, ALIKE = 0.04, 16, 8
#: Tokens of a chunk, of a training sequence, and distinct words kept between blocks.
CHUNK, SEQUENCE, KEPT = 64, 32, 300_000
_TRIM = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„’…"


@dataclass
class Field:
    """Weights of the toxic state against the other, and of the transitions (from, to)."""

    weights: np.ndarray
    change: np.ndarray

    def odds(self, words: list[str]) -> np.ndarray:
        """Log odds that a word's features give the toxic state."""
        return self.weights[features(words)].sum(1)


def words_of(text: str) -> list[str]:
    """Words as scoring takes them: runs of other than ASCII white space."""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def features(words: list[str]) -> np.ndarray:
    """Hashes of each word without its punctuation, in lower case, of its prefixes of 3 to 6 characters, and of a feature that all share."""
    out = np.zeros((len(words), 6), np.int64)
    crc = zlib.crc32
    mask = FEATURES - 1
    for i, w in enumerate(words):
        w = w.lower().strip(_TRIM) or w
        b = w.encode()
        out[i, 0] = crc(b"w" + b) & mask
        for k in (3, 4, 5, 6):
            out[i, k - 2] = crc(b"%d" % k + (w[:k].encode() if len(w) >= k else b"")) & mask
    return out


def train(texts: list[str], toxic: list[int]) -> Field:
    """The field learnt from whole texts and their labels; all weights are 0 unless both labels occur."""
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)))
    if not (any(toxic) and not all(toxic)):
        return field
    ids: dict[str, int] = {}
    tokens = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int64) for t in texts]
    of = features(list(ids))
    # in how many documents of each label a feature occurs
    seen = np.zeros((2, FEATURES))
    held = [np.unique(of[np.unique(t)]) if len(t) else np.zeros(0, np.int64) for t in tokens]
    for h, y in zip(held, toxic, strict=True):
        seen[int(bool(y)), h] += 1
    share = seen / [[sum(not y for y in toxic)], [sum(map(bool, toxic))]]
    least = max(SUPPORT, SUPPORT_SHARE * sum(map(bool, toxic)))
    able = np.flatnonzero((seen[1] >= least) & (share[1] >= PURITY * (share[0] + share[1])))
    bad = [h for h, y in zip(held, toxic, strict=True) if y]
    word = (_chosen(able, bad, least) | _frequent(able, _distinct(bad)))[of].any(1)
    # sequences of equal length; the rest of the last is padding
    rows, labels = [], []
    for t, y in zip(tokens, toxic, strict=True):
        n = -(-len(t) // SEQUENCE) * SEQUENCE
        pad = np.full(n, -1, np.int64)
        pad[: len(t)] = t
        rows.append(pad.reshape(-1, SEQUENCE))
        labels.append(((pad >= 0) & word[pad] & bool(y)).reshape(-1, SEQUENCE))
    x, y = np.concatenate(rows), np.concatenate(labels)
    # sequences with a marked token, and twice as many others
    draw = np.random.Generator(np.random.PCG64(5))
    marked = draw.permutation(np.flatnonzero(y.any(1)))[:TRAIN_MARKED]
    other = draw.permutation(np.flatnonzero(~y.any(1)))[: min(TRAIN_OTHER, max(2_000, 2 * len(marked)))]
    pick = np.concatenate([marked, other])
    x, y = x[pick], y[pick]
    real = x >= 0
    used, index = np.unique(x[real], return_inverse=True)
    of = of[used]
    squares, moves = np.full(FEATURES, 1e-8), np.full((2, 2), 1e-8)
    gold = np.bincount(index, y[real], len(used))
    pairs = real[:, 1:] & real[:, :-1]
    gold_moves = np.array([[(pairs & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(ROUNDS):
        odds = np.zeros(x.shape)
        odds[real] = field.weights[of].sum(1)[index]
        p, expected = _sequences(odds, real, field.change)
        diff = gold - np.bincount(index, p[real], len(used))
        grad = np.bincount(of.ravel(), np.repeat(diff, of.shape[1]), FEATURES) / len(x) - PENALTY * field.weights
        squares += grad**2
        field.weights += RATE * grad / np.sqrt(squares)
        grad = (gold_moves - expected) / len(x)
        moves += grad**2
        field.change += RATE * grad / np.sqrt(moves)
    return field


def _chosen(able: np.ndarray, held: list[np.ndarray], least: float) -> np.ndarray:
    """A flag per feature: greedily, the feature that marks most documents that still lack some, while it marks enough."""
    marks = np.zeros(FEATURES, bool)
    has = np.stack([np.isin(able, h, assume_unique=True) for h in held]) if len(able) else np.zeros((len(held), 0), bool)
    lacks = np.full(len(held), COVER)
    while has.shape[1]:
        gain = (lacks > 0) @ has.astype(np.int32)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        marks[able[best]] = True
        lacks -= has[:, best]
        has[:, best] = False
    return marks


def _distinct(held: list[np.ndarray]) -> list[np.ndarray]:
    """The features of documents, near copies of which are one with the features that all of them have."""
    draw = np.random.Generator(np.random.PCG64(8))
    order = [draw.permutation(FEATURES) for _ in range(SKETCH)]
    sketch = np.array([[o[h].min() if len(h) else -1 for o in order] for h in held])
    kinds: dict[int, np.ndarray] = {}
    kind = np.arange(len(held))
    for i, h in enumerate(held):  # with the first document that it is alike to
        kind[i] = kind[int(np.flatnonzero((sketch[: i + 1] == sketch[i]).sum(1) >= ALIKE)[0])]
        k = int(kind[i])
        kinds[k] = np.intersect1d(kinds[k], h) if k in kinds else h
    return list(kinds.values())


def _frequent(able: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
    """A flag per feature: whether it is in enough of the documents."""
    marks = np.zeros(FEATURES, bool)
    if len(able) and held:
        many = np.sum([np.isin(able, h, assume_unique=True) for h in held], 0)
        marks[able[many >= max(SUPPORT, OFTEN * len(held))]] = True
    return marks


def _sequences(odds: np.ndarray, real: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state and expected transitions, for sequences padded at their ends."""
    n, length = odds.shape
    move = np.exp(change)
    emit = np.stack([np.ones_like(odds), np.exp(np.clip(odds, -30, 30))], 2)
    ahead, back = np.empty((length, n, 2)), np.ones((length, n, 2))
    ahead[0] = emit[:, 0]
    ahead[0] /= ahead[0].sum(1, keepdims=True)
    for t in range(1, length):
        step = (ahead[t - 1] @ move) * emit[:, t]
        ahead[t] = np.where(real[:, t, None], step / step.sum(1, keepdims=True), ahead[t - 1])
    expected = np.zeros((2, 2))
    for t in range(length - 2, -1, -1):
        after = emit[:, t + 1] * back[t + 1]
        both = ahead[t][:, :, None] * move * after[:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        expected += both[real[:, t + 1]].sum(0)
        step = after @ move.T
        back[t] = np.where(real[:, t + 1, None], step / step.sum(1, keepdims=True), 1)
    p = ahead * back
    return (p[:, :, 1] / p.sum(2)).T, expected


def marginals(odds: np.ndarray, first: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Marginals of the toxic state of every token; first[d] is the index of text d's first token."""
    size = np.diff(first)
    chunks = -(-size // CHUNK)
    total = int(chunks.sum())
    if not total:
        return np.zeros(0)
    begin = np.cumsum(chunks) - chunks
    text = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(odds)) - first[:-1][text] + begin[text] * CHUNK
    move = np.exp(change)
    weight, real = np.ones(total * CHUNK), np.zeros(total * CHUNK, bool)
    weight[at] = np.exp(np.clip(odds, -30, 30))
    real[at] = True
    weight, real = weight.reshape(total, CHUNK).T.copy(), real.reshape(total, CHUNK).T.copy()
    # a text's first token has no transition before it
    initial = np.zeros(total, bool)
    initial[begin[size > 0]] = True
    product = np.tile(np.eye(2), (total, 1, 1))
    for t in range(CHUNK):
        m = np.where(initial[:, None, None], np.eye(2), move) if t == 0 else move
        step = product @ m
        step[:, :, 1] *= weight[t][:, None]
        step /= step.sum((1, 2), keepdims=True)
        product = np.where(real[t][:, None, None], step, product)
    # over the chunks of each text, all texts together
    into, out = np.ones((total, 2)), np.ones((total, 2))
    most = int(chunks.max())
    by = np.argsort(-chunks, kind="stable")
    reach = np.searchsorted(-chunks[by], -np.arange(1, most + 1), "right")
    for k in range(1, most):
        c = begin[by[: reach[k]]] + k
        v = np.einsum("ni,nij->nj", into[c - 1], product[c - 1])
        into[c] = v / v.sum(1, keepdims=True)
    for k in range(most - 2, -1, -1):
        c = begin[by[: reach[k + 1]]] + k
        v = np.einsum("nij,nj->ni", product[c + 1], out[c + 1])
        out[c] = v / v.sum(1, keepdims=True)
    ahead = np.empty((CHUNK, total, 2))
    v = into
    for t in range(CHUNK):
        step = np.where(initial[:, None], v, v @ move) if t == 0 else v @ move
        step[:, 1] *= weight[t]
        v = np.where(real[t][:, None], step / step.sum(1, keepdims=True), v)
        ahead[t] = v
    p = np.empty((CHUNK, total))
    v = out
    for t in range(CHUNK - 1, -1, -1):
        q = ahead[t] * v
        p[t] = q[:, 1] / q.sum(1)
        step = v.copy()
        step[:, 1] *= weight[t]
        if t:
            step = step @ move.T
            v = np.where(real[t][:, None], step / step.sum(1, keepdims=True), v)
    return p.T.ravel()[at]


class Scorer:
    """Scores blocks of texts, keeping the odds of up to KEPT distinct words."""

    def __init__(self, field: Field):
        self.field = field
        self.kept: dict[int, float] = {}

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(marginals, starts, ends, first token of each text)."""
        starts, ends, first = bounds(data, offsets)
        distinct, index, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.kept) + len(distinct) > KEPT:
            self.kept = {}
        get = self.kept.get
        odds = np.array([get(h, np.nan) for h in distinct.tolist()])
        new = np.flatnonzero(np.isnan(odds))
        if len(new):
            raw = data.tobytes()
            odds[new] = self.field.odds([raw[a:b].decode() for a, b in zip(starts[index[new]].tolist(), ends[index[new]].tolist(), strict=True)])
            self.kept.update(zip(distinct[new].tolist(), odds[new].tolist(), strict=True))
        return marginals(odds[inverse], first, self.field.change), starts, ends, first


def _scoring(field: Field, carry: list[str], with_spans: bool):
    def run(batches):
        scorer = Scorer(field)
        for batch in batches:
            scores, spans = [], []
            for row, end, data, offsets in blocks(batch.column("text"), 4 << 20):
                p, starts, ends, first = scorer.block(data, offsets)
                size = np.diff(first)
                score = np.zeros(end - row)
                if len(p):
                    score[size > 0] = np.maximum.reduceat(p, first[:-1][size > 0])
                scores.append(score)
                if with_spans:
                    hit = p >= 0.5
                    for d in range(end - row):
                        found = []
                        if score[d] >= 0.5:
                            on = hit[first[d] : first[d + 1]]
                            for a, b in np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8))).reshape(-1, 2) + first[d]:
                                head = data[offsets[d] : starts[a]].tobytes().decode()
                                found.append({"start": len(head), "end": len(head) + len(data[starts[a] : ends[b - 1]].tobytes().decode()), "p": float(p[a:b].max())})
                        spans.append(found)
            columns = [*(batch.column(c) for c in carry), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, [*carry, "y", "spans"][: len(columns)])

    return run


def learnt(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = TRAIN_EACH) -> Field:
    """The field from up to `each` labelled documents of either label, those of least md5 of the id.

    Both tables hold only rows to learn from. Ids in one table alone, null ids, labels and texts, and texts over
    TRAIN_LONGEST bytes are left out; with one label alone, all weights are 0 and every text with words scores one half.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.join(docs.where(F.octet_length(text_col) <= TRAIN_LONGEST).select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").distinct()
    order = [F.md5(F.col("id").cast("string").cast("binary")), "id"]
    picked = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(*order).limit(each).collect()]
    ids = spark.createDataFrame([(r["id"], r["y"]) for r in picked], "id long, y int")  # at most 2 · each rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= TRAIN_LONGEST).join(F.broadcast(ids), "id").collect()
    rows.sort(key=lambda r: (r["y"], r["id"], r["text"]))
    return train([r["text"] for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, field: Field, text_col: str = "text", into: str = "score", spans: str | None = "spans", carry: list[str] | None = None) -> DataFrame:
    """The rows (columns in `carry`, all by default) with `into`, the greatest marginal of the toxic state, and `spans`.

    Spans are (start, end, p): character offsets of stretches of tokens with a marginal of at least one half. Texts
    without words, and null, score 0 and have no spans. Columns named like the new ones are replaced.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in (into, spans)]
    names = [f"c{i}" for i in range(len(keep))]  # apart from any name of the input
    part = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([*(f"{n} {part.schema[n].dataType.simpleString()}" for n in names), "y double", *(["spans array<struct<start:bigint,end:bigint,p:double>>"] if spans else [])])
    out = part.mapInArrow(_scoring(field, names, bool(spans)), schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), F.col("y").alias(into), *([F.col("spans").alias(spans)] if spans else []))
