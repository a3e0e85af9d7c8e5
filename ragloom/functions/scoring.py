"""Scores of generated answers and of retrieval."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _orders(words: list[str]) -> list[Counter]:
    return [Counter(zip(*(words[i:] for i in range(n)), strict=False)) for n in range(1, 5)]


def sentence_bleu(answer: list[str], reference: list[str]) -> float:
    """BLEU of one answer, uniform over 1 to 4-grams.

    The i-th order without a match is smoothed to ln(length) / (2**i · 5) matches. An answer of fewer than two words,
    or without any common word, scores 0.
    """
    size = len(answer)
    if size < 2 or not set(answer) & set(reference):
        return 0.0
    total, empty = 0.0, 0
    for have, want in zip(_orders(answer), _orders(reference), strict=True):
        hits = (have & want).total()
        if not hits:
            empty += 1
            hits = math.log(size) / (2**empty * 5)
        total += math.log(hits / max(1, have.total())) / 4
    return math.exp(total + min(0.0, 1 - len(reference) / size))


@F.pandas_udf(DoubleType())
def bleu(answer: pd.Series, reference: pd.Series) -> pd.Series:
    """sentence_bleu over white-space words; null counts as empty."""
    return pd.Series([sentence_bleu((x or "").split(), (y or "").split()) for x, y in zip(answer, reference, strict=True)], dtype=float)


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a bit vector over the shorter, one step a word of the other."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        both = row & places.get(w, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(answer: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words; 0 without common words."""
    out = np.zeros(len(answer))
    for i, (x, y) in enumerate(zip(answer, reference, strict=True)):
        a, b = (x or "").split(), (y or "").split()
        if a and b and (n := _common(a, b)):
            p, r = n / len(a), n / len(b)
            out[i] = 2 * p * r / (p + r)
    return pd.Series(out)


def recall_at_k(ids: Column, relevant: Column) -> Column:
    """1 when the relevant id is among the ids, else 0; null ids count as none."""
    return F.coalesce(F.array_contains(ids, relevant), F.lit(False)).cast("int")


def reciprocal_rank(ids: Column, relevant: Column) -> Column:
    place = F.coalesce(F.array_position(ids, relevant), F.lit(0))
    return F.when(place > 0, F.lit(1.0) / place).otherwise(F.lit(0.0))
