"""Quality rules as a short-circuit cascade.

Each rule is a Boolean column expression with the features it needs inlined. A bounded sample gives each
rule's rejections and its cost; rules then run by rejection per cost, and the first that rejects a row
ends its evaluation (a CASE of the rules in that order). The order changes only what a row costs: a row
is kept if no rule rejects it. DataFrame and SQL functions only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the characters that part words, and those that count as symbols
_SPACES, _SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Rows of the sample on which rules are measured (expected; drawn from all partitions by a seed), bytes of the longest text in it, and how often each is judged.
SAMPLE_ROWS, SAMPLE_LONGEST, SAMPLE_TIMES = 1_000, 1 << 14, 6


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once per row: a lambda's variable, not an expression that is inlined at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without(text: Column, characters: str, instead: str = "") -> Column:
    """Byte searches, a character at a time: cheaper than a translation table or a pattern, which visit every code point."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(instead))
    return text


def words(text: Column) -> Column:
    return F.filter(F.split(_without(text, _SPACES[1:], " "), " "), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(_without(text, _SPACES)).cast("long")


def symbols(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(_without(text, _SYMBOLS))).cast("long")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.ltrim(x, F.lit(_SPACES))) > 0)


def _repeated(w: Column, n: int = 3) -> Column:
    """Words that stand in a window of n words found twice or more in the array."""

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, j: (F.get(s, j)["x"] == e["x"])
            again = F.filter(s, lambda e, j: F.coalesce(same(e, j + 1), F.lit(False)) | ((j > 0) & F.coalesce(same(e, F.greatest(j - 1, F.lit(0))), F.lit(False))))
            start = F.array_sort(F.transform(again, lambda e: e["i"]))
            begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(start, begin, lambda a, i: F.struct((a["n"] + i + n - F.greatest(a["end"], i)).alias("n"), (i + n).alias("end")), lambda a: a["n"])

        return _let(placed, twice)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    found = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) <= n, F.lit(0)).otherwise(found).cast("long")


def word_features(text: Column) -> Column:
    """n_words and n_repeat_words, from one split of the text."""
    return _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))


@dataclass(frozen=True)
class Rule:
    """`rejects` is a Boolean of the text `t` and the base features, with what else it needs inlined; null counts as not rejected."""

    name: str
    rejects: Callable[[], Column] | str


#: The rules of the cascade; every share is of what the text holds as a whole.
RULES = (
    Rule("symbols", "n_symbols * 100 > word_chars * 5"),
    Rule("few_words", lambda: F.size(F.array_distinct(words(F.col("t")))) * 10 < F.col("n_words") * 2),
    Rule("word_length", "word_chars < n_words * 2 or word_chars > n_words * 20"),
    Rule("shouting", "(octet_length(t) - octet_length(replace(replace(t, '!', ''), '?', ''))) * 2 > n_words"),
    Rule("same_lines", lambda: (F.col("n_dup_lines") > 0) & (F.col("n_dup_lines") * 10 > F.size(lines(F.col("t"))) * 6)),
    Rule("capitals", r"regexp_count(t, r'\p{Lu}') * 10 > word_chars * 4"),
    Rule("letters", r"(word_chars - regexp_count(t, r'[^\p{L}\x20\x09-\x0D]')) * 10 < word_chars * 4"),
)


def _condition(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.rejects) if isinstance(rule.rejects, str) else rule.rejects(), F.lit(False))


def _features(rows: DataFrame) -> DataFrame:
    """Base features of the text `t`."""
    split = rows.withColumn("w", word_features(F.col("t"))).withColumn("x", _let(lines(F.col("t")), lambda x: F.struct(F.size(x).alias("n_lines"), F.size(F.array_distinct(x)).alias("d"))))
    return split.select(
        *rows.columns, "w.*", (F.col("x.n_lines") - F.col("x.d")).cast("long").alias("n_dup_lines"), word_chars(F.col("t")).alias("word_chars"), symbols(F.col("t")).alias("n_symbols")
    )


def ordered(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules by rejections per second on a sample, most first; ties and an empty sample keep the given order.

    Only rows that reach the cascade count, those that the base features keep. A rule's cost is the time of judging
    them SAMPLE_TIMES times over by compiled code, less that of reading them; of two such times the shorter counts.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("t")).where(F.octet_length("t") <= SAMPLE_LONGEST)
    rows = texts.count()
    taken = texts.sample(False, min(1.0, SAMPLE_ROWS / max(1, rows)), seed=7).collect()
    sample = _features(docs.sparkSession.createDataFrame(taken, "t string").coalesce(1)).where(~_base_failed()).cache()
    again = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_TIMES))))

    def timed(condition: Column) -> tuple[float, int]:
        job = again.agg(F.sum(condition.cast("long")).alias("n"))
        job.first()  # compiles, and fills the cache
        took = []
        for _ in range(2):
            began = time.perf_counter()
            hits = job.first()["n"] or 0
            took.append(time.perf_counter() - began)
        return min(took), hits

    none = timed(F.octet_length("t") < 0)[0]
    rate = []
    for i, rule in enumerate(rules):
        cost, hits = timed(_condition(rule))
        rate.append((-hits / max(1e-4, cost - none), i))
    sample.unpersist()
    return [rules[i] for _, i in sorted(rate)]


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input's rows and columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    `base_failed`: fewer than 50 words, or more than half of them in repeated 3-word windows. `kept` is false for those,
    else whether every rule of the cascade passes. A null text counts as empty. Columns named like the new ones are replaced;
    repeated rows are judged alike. 3-word windows are equal when their 64-bit hashes are, within one text.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    keep = [c for c in docs.columns if c not in new]
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rejected = F.lit(False)
    for rule in reversed(ordered(plain, "t", rules)):
        rejected = F.when(_condition(rule), F.lit(True)).otherwise(rejected)
    out = _features(plain)
    out = out.withColumn("base_failed", _base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~rejected))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *new)


#: DuckDB's form of the query op7.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, len(w) AS n, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS wc,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS sy,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM l)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE k > 1) GROUP BY doc_id),
f AS (
  SELECT l.doc_id, n, wc, sy, len(ln) - len(list_distinct(ln)) AS dup, len(ln) AS nl, coalesce(rep, 0) AS rep,
         n < 50 OR 100 * coalesce(rep, 0) > 50 * n AS base,
         sy * 100 > wc * 5
         OR length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) * 10 > wc * 4
         OR length(regexp_replace(t, '[^!?]', '', 'g')) * 2 > n
         OR length(regexp_replace(t, '[^\p{L}]', '', 'g')) * 10 < wc * 4
         OR len(list_distinct(w)) * 10 < n * 2
         OR (len(ln) - len(list_distinct(ln))) * 10 > len(ln) * 6
         OR wc < n * 2 OR wc > n * 20 AS bad
  FROM l LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(wc AS BIGINT) AS word_chars, CAST(sy AS BIGINT) AS n_symbols,
       CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, base AS base_failed, NOT base AND NOT bad AS kept
FROM f
"""
