"""Words of several syllables: a lexicon learnt from the corpus, and the cheapest path through the lattice of its entries.

Runs of syllables that are not parted by punctuation are counted up to LONGEST syllables. A run of several is an entry
if it is frequent and, however it is parted in two, its parts meet more often than chance has it (pointwise mutual
information as a share of its greatest value). An entry costs the negated logarithm of its share; the best segmentation
of a sentence is the path of least cost, of equal ones that of fewer words, then of longer first words.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ragloom.functions import text as T
from ragloom.operators.lasting import lasting

#: Syllables of an entry at most, its least count and least normalised information, and entries of the model at most (the most frequent ones).
LONGEST, LEAST, TOGETHER, MOST = 3, 4, 0.35, 100_000
_PART = r"[^\p{L}\p{M}\p{N}_\s]+|\n+"


def run_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(words, size, n): how often each run of 1 to `longest` syllables occurs, in lower case, apart by blanks.

    Every syllable is counted once, with those after it; the shorter runs come from these counts.
    """
    # outer ones and a filter behind them: a filter before a generator would split each text once more
    parts = docs.select(F.explode_outer(F.split(F.lower(F.col(text_col)), _PART)).alias("_part")).select(T.tokens(F.col("_part")).alias("_w"))
    names = [f"_{k}" for k in range(longest)]
    after = [F.slice("_w", k + 1, F.size("_w")).alias(name) for k, name in enumerate(names)]
    counts = parts.select(F.inline_outer(F.arrays_zip(*after))).where(F.col(names[0]).isNotNull()).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    first = lambda k: F.struct(F.concat_ws(" ", *names[:k]).alias("words"), F.lit(k).alias("size"), F.col(names[k - 1]).isNotNull().alias("whole"))
    runs = counts.select("_n", F.explode(F.array(*(first(k + 1) for k in range(longest)))).alias("_r")).where("_r.whole")
    return runs.groupBy("_r.words", "_r.size").agg(F.sum("_n").alias("n"))


def _frequent(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """The counts of all syllables, and of longer runs that occur `least` times; the parts of such a run do as well."""
    return lasting(run_counts(docs, text_col, longest).where((F.col("size") == 1) | (F.col("n") >= least)))


def entries(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, least: int = LEAST, together: float = TOGETHER) -> DataFrame:
    """(words, size, n, bound): the entries of several syllables; `bound` is the least normalised information of a run's two parts."""
    return _entries(_frequent(docs, text_col, longest, least), least, together)


def _entries(counts: DataFrame, least: int, together: float) -> DataFrame:
    total = F.broadcast(counts.where("size = 1").agg(F.sum("n").alias("_all")))  # one row
    long = counts.where((F.col("size") > 1) & (F.col("n") >= least)).crossJoin(total)
    split = F.split("words", " ")
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("_at"))
    cuts = cuts.select("*", F.array_join(F.slice(split, 1, F.col("_at")), " ").alias("_a"), F.array_join(F.slice(split, F.col("_at") + 1, F.col("size")), " ").alias("_b"))
    part = lambda c: counts.select(F.col("words").alias(c), F.col("n").alias(f"{c}_n"))
    both = cuts.join(part("_a"), "_a").join(part("_b"), "_b")
    share = F.log(F.col("n") * F.col("_all") / (F.col("_a_n") * F.col("_b_n"))) / -F.log(F.col("n") / F.col("_all"))
    return both.groupBy("words", "size", "n").agg(F.min(share).alias("bound")).where(F.col("bound") >= together)


@dataclass
class Lexicon:
    """Costs of entries and of single syllables, the cost of an unknown one, and the longest entry's syllables."""

    costs: dict[str, float]
    unknown: float
    longest: int

    @cached_property
    def _tree(self) -> dict:
        """Entries by their syllables: each to the entry's cost or None, and what may follow."""
        tree: dict = {}
        for entry, cost in self.costs.items():
            after, syllables = tree, entry.split(" ")
            if len(syllables) <= self.longest:
                for syllable in syllables:
                    node = after.setdefault(syllable, [None, {}])
                    after = node[1]
                node[0] = cost
        return tree

    def words(self, syllables: list[str]) -> list[list[str]]:
        """The best segmentation of a run of syllables."""
        tree, unknown = self._tree, self.unknown
        n, keys = len(syllables), [s.lower() for s in syllables]
        # from each place on: least cost, words, then the longest first word
        costs, words, sizes = [0.0] * (n + 1), [0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            cost, after = tree.get(keys[i], (None, None))
            least, many, j = round((unknown if cost is None else cost) + costs[i + 1], 9), words[i + 1], i + 1
            while after and j < n and (node := after.get(keys[j])):
                cost, after = node
                j += 1
                if cost is not None and ((whole := round(cost + costs[j], 9)) < least or whole == least and words[j] <= many):
                    least, many, sizes[i] = whole, words[j], j - i
            costs[i], words[i] = least, many + 1
        out, i = [], 0
        while i < n:
            out.append(syllables[i : i + sizes[i]])
            i += sizes[i]
        return out

    def line(self, sentence: str) -> str:
        """A sentence with the syllables of a word joined by `_`; punctuation parts words and stays with its syllable."""
        out, held, begin = [], [], ""
        for token in sentence.split():
            head, bare, tail = ("", token, "") if token.isalnum() else _bare(token)
            if held and head:
                out += self._joined(begin, held)
                held = []
            begin = begin if held else head
            held.append(bare)
            if tail:
                out += self._joined(begin, held, tail)
                held = []
        return " ".join(out + self._joined(begin, held))

    def _joined(self, head: str, held: list[str], tail: str = "") -> list[str]:
        if not held:
            return []
        words = ["_".join(w) for w in self.words(held)]
        words[0] = head + words[0]
        words[-1] += tail
        return words


_TOKEN = re.compile(r"(\W*)(.*?)(\W*)", re.S)


@lru_cache(1 << 14)
def _bare(token: str) -> tuple[str, str, str]:
    """What is before a token's syllable, the syllable, and what is behind it."""
    return _TOKEN.fullmatch(token).groups()


def learnt(docs: DataFrame, text_col: str = "text", most: int = MOST, longest: int = LONGEST, least: int = LEAST, together: float = TOGETHER) -> Lexicon:
    """The lexicon of a corpus: its entries of several syllables and its syllables, the `most` most frequent of each (their number bounds the model)."""
    counts = _frequent(docs, text_col, longest, least)
    long, single = _entries(counts, least, together), counts.where("size = 1")
    total = single.agg(F.sum("n")).first()[0] or 0
    top = lambda df: lasting(df.select("words", "n").orderBy(F.desc("n"), "words").limit(most)).collect()  # noqa: E731 - put together in a task
    costs = {r["words"]: -math.log(r["n"] / total) for df in (single, long) for r in top(df)}
    return Lexicon(costs, math.log(total + 1) + 1, longest)


def segmented(text: Column, lexicon: Lexicon) -> Column:
    """The text's sentences, by end marks and lines, with words joined; empty for null and blank texts."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda s: [] if s is None else [lexicon.line(x) for x in s])

    return run(T.nonblank(T.sentences(text)))
