"""Sentence borders learnt from a corpus without labels: abbreviations, sentence starters and collocations by log-likelihood.

One scan counts pairs of neighbouring words in a short form; everything that is learnt comes from that table by joins
and aggregates, down to a decision for each pair (word with a period, next word) that occurs. Texts are then cut at
every mark that may end a sentence, the words beside a cut take their decision by a join, and each document's pieces are
put together at the places where no sentence ends. Nothing of the vocabulary passes the driver or is broadcast by hand.

After Kiss and Strunk, "Unsupervised multilingual sentence boundary detection" (2006), with these forms: words are runs
of other than white space without quotes and brackets around them, a line end is always a border, and `!` and `?` end
a sentence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators.lasting import lasting

# fixed values of the published method: least scores of abbreviations, sentence starters and collocations; share of periods after an abbreviation
ABBREVIATION, STARTER, COLLOCATION, OFTEN = 0.3, 30.0, 7.88, 0.99
_OPEN, _CLOSE = "\"'([{«“‘„", "\"')]}»”’"
_CUT, _LINE = "﷐", "﷑"  # no characters of texts
_STOP = r"[.!?…][\"')\]}»”’]*$"
_END = r"([.!?…][\"')\]}»”’]*) "


def shaped(rows: DataFrame, word: str, prefix: str) -> DataFrame:
    """Adds of a word its `type` (lower case, numbers as one), `stop` (. period, e ellipsis, b other end, empty) and `case` (U, l, empty).

    A projection a step, so that no step is worked out again for each use.
    """
    body, base = f"_{prefix}_body", f"_{prefix}_base"
    out = rows.withColumn(body, F.rtrim(F.ltrim(F.col(word), F.lit(_OPEN)), F.lit(_CLOSE)))
    out = out.withColumn(base, F.lower(F.rtrim(F.col(body), F.lit(".!?…,;:–"))))
    first, end = F.substring(body, 1, 1), F.col(body)
    return out.withColumns(
        {
            f"{prefix}type": F.when(F.col(base).rlike(r"^[-+]?[.,]?[0-9][0-9.,:%/-]*$"), F.lit("##")).otherwise(F.col(base)),
            f"{prefix}stop": F.when(end.endswith("..") | end.endswith("…"), F.lit("e")).when(end.endswith("."), F.lit(".")).when(end.endswith("!") | end.endswith("?"), F.lit("b")).otherwise(F.lit("")),
            f"{prefix}case": F.when(first.rlike(r"^\p{Lu}"), F.lit("U")).when(first.rlike(r"^\p{Ll}"), F.lit("l")).otherwise(F.lit("")),
        }
    ).drop(body, base)


def pair_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key1, stop1, type2, stop2, case2, n): how often a word follows another one, of which only the stop and, with a period, the type is told.

    The first word of a line follows stop `^`. Null and empty texts have no words.
    """
    lines = docs.select(F.explode(F.split(F.col(text_col), r"\n+")).alias("_line")).select(T.tokens(F.col("_line")).alias("_w"))
    pairs = lines.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.col("_w")).alias("a"), F.col("_w").alias("b"))).alias("_p")).where("_p.b is not null")
    both = shaped(shaped(pairs.select("_p.a", "_p.b"), "a", "a_"), "b", "b_")
    stop1 = F.when(F.col("a").isNull(), F.lit("^")).otherwise(F.col("a_stop"))
    out = both.select(F.when(stop1 == ".", F.col("a_type")).otherwise(F.lit("")).alias("key1"), stop1.alias("stop1"), F.col("b_type").alias("type2"), F.col("b_stop").alias("stop2"), F.col("b_case").alias("case2"))
    return out.groupBy("key1", "stop1", "type2", "stop2", "case2").agg(F.count(F.lit(1)).alias("n"))


def _safe_log(x: Column) -> Column:
    return F.log(x + F.lit(1e-8))


def _tied(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of b coming after a more or less often than elsewhere."""
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    part = lambda k, m, q: F.when((q <= 0) | (q >= 1), F.lit(0.0)).otherwise(k * F.log(q) + (m - k) * F.log(1 - q))
    return -2 * (part(ab, a, p) + part(b - ab, n - a, p) - part(ab, a, p1) - part(b - ab, n - a, p2))


@dataclass
class Borders:
    """What was learnt, as tables: abbreviations (type, score), starters (type, score), collocations (a, b, score), and
    decisions (key1, stop1, type2, case2, ends) for each pair that occurs and whose first word may or may not end a sentence."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    decisions: DataFrame


def learnt(docs: DataFrame, text_col: str = "text") -> Borders:
    """The borders of a corpus; an empty one teaches nothing, so that every period ends a sentence."""
    pairs = lasting(pair_counts(docs, text_col).where("type2 <> ''"))
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop2") == ".", F.col("n")).otherwise(0)).alias("periods"), F.lit(1).alias("_one"))
    types = pairs.groupBy(F.col("type2").alias("type")).agg(F.sum("n").alias("n_type"), F.sum(F.when(F.col("stop2") == ".", F.col("n")).otherwise(0)).alias("n_with"))

    def with_total(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")  # one row

    # abbreviations: short types that nearly always carry their period, and have more within
    inner = F.length("type") - F.length(F.regexp_replace("type", r"\.", ""))
    letters = F.length("type") - inner
    without = F.col("n_type") - F.col("n_with")
    share = F.col("periods") / F.col("n")
    chance = F.col("n_with") * _safe_log(share) + without * _safe_log(1 - share)
    always = F.col("n_with") * F.log(F.lit(OFTEN)) + without * F.log(F.lit(1 - OFTEN))
    score = -2 * (chance - always) * F.exp(-letters) * (inner + 1) * F.exp(-without * F.log(letters.cast("double")))
    seen = with_total(types.where((F.col("n_with") > 0) & (F.col("type") != "##") & F.col("type").rlike(r"\p{L}")))
    abbreviations = lasting(seen.select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION))

    known = abbreviations.select(F.col("type").alias("key1"), F.lit(True).alias("short"))
    ends = (F.col("stop1") == "b") | ((F.col("stop1") == ".") & F.col("short").isNull())
    followed = lasting(pairs.groupBy("key1", "stop1", "type2", "case2").agg(F.sum("n").alias("n")).join(known, "key1", "left").withColumn("ends", ends))

    # in which case a type occurs, at a sentence's start and within
    start = F.col("ends") | (F.col("stop1") == "^")
    has = lambda when: F.max(F.when(when, 1).otherwise(0)) == 1
    upper, lower, inside = F.col("case2") == "U", F.col("case2") == "l", F.col("stop1") == ""
    cases = followed.groupBy(F.col("type2").alias("type")).agg(
        has(start & upper).alias("start_upper"), has(start & lower).alias("start_lower"), has(inside & upper).alias("in_upper"), has(upper).alias("any_upper"), has(lower).alias("any_lower")
    )

    real = followed.where("ends")
    counts = with_total(real.where(F.col("type2").rlike(r"^\p{L}")).groupBy(F.col("type2").alias("type")).agg(F.sum("n").alias("n_start")).join(types, "type"))
    ended = real.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ended"), F.lit(1).alias("_one"))
    counts = counts.withColumn("_one", F.lit(1)).join(F.broadcast(ended), "_one")  # one row
    tied = _tied(F.col("ended"), F.col("n_type"), F.col("n_start"), F.col("n"))
    starters = lasting(counts.where(F.col("n") / F.col("ended") > F.col("n_type") / F.col("n_start")).select("type", tied.alias("score")).where(F.col("score") >= STARTER))

    maybe = followed.where((F.col("stop1") == ".") & (F.col("short") | (F.col("key1") == "##") | F.col("key1").rlike(r"^\p{L}$")) & F.col("type2").rlike(r"^\p{L}"))
    both = maybe.groupBy(F.col("key1").alias("a"), F.col("type2").alias("b")).agg(F.sum("n").alias("n_both"))
    both = both.join(starters.select(F.col("type").alias("b")), "b", "left_anti")
    both = both.join(types.select(F.col("type").alias("a"), F.col("n_type").alias("n_a")), "a").join(types.select(F.col("type").alias("b"), F.col("n_type").alias("n_b")), "b")
    tied = _tied(F.col("n_a"), F.col("n_b"), F.col("n_both"), F.col("n"))
    collocations = lasting(with_total(both).where(F.col("n") / F.col("n_a") > F.col("n_b") / F.col("n_both")).select("a", "b", tied.alias("score")).where(F.col("score") >= COLLOCATION))

    asked = followed.where("stop1 in ('.', 'e')").select("key1", "stop1", "type2", "case2", "short").distinct()
    asked = asked.join(cases.withColumnRenamed("type", "type2"), "type2", "left").join(starters.select(F.col("type").alias("type2"), F.lit(True).alias("opens")), "type2", "left")
    asked = asked.join(collocations.select(F.col("a").alias("key1"), F.col("b").alias("type2"), F.lit(True).alias("together")), ["key1", "type2"], "left")
    says_end = upper & F.col("any_lower") & ~F.col("in_upper")
    says_on = lower & (F.col("any_upper") | ~F.col("start_lower"))
    opens = says_end | (upper & F.col("opens").isNotNull())
    single = F.col("key1").rlike(r"^\p{L}$")
    loose = F.when(says_on, False).when(~says_end & single & upper & ~F.col("any_lower"), False).otherwise(True)
    decided = (
        F.when((F.col("stop1") == ".") & F.col("together").isNotNull(), False)
        .when((F.col("stop1") == ".") & (single | (F.col("key1") == "##")), loose)
        .when((F.col("stop1") == "e") | F.col("short").isNotNull(), opens)
        .otherwise(True)
    )
    return Borders(abbreviations, starters, collocations, lasting(asked.select("key1", "stop1", "type2", "case2", decided.alias("ends"))))


def _pieces(text: Column) -> Column:
    """A text cut at every mark that may end a sentence and at line ends; pieces that begin a line are marked."""
    clean = F.translate(F.coalesce(text, F.lit("")), _CUT + _LINE, "")
    marked = F.regexp_replace(T.strip(clean), rf"{T.SPACE}*\n{T.SPACE}*", _CUT + _LINE)
    return F.split(F.regexp_replace(F.regexp_replace(marked, T.SPACE + "+", " "), _END, "$1" + _CUT), _CUT)


def sentences(docs: DataFrame, borders: Borders, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, sentences): the sentences of each text in order, white space squeezed; empty for null and blank texts.

    `doc` identifies rows. Pairs that were not seen when learning end a sentence, but for known abbreviations and ellipses.
    """
    pieces = docs.select(F.col(doc), _pieces(F.col(text_col)).alias("_p"))
    pieces = pieces.select(doc, F.posexplode(F.arrays_zip(F.col("_p").alias("text"), F.slice("_p", 2, F.size("_p")).alias("next")))).select(doc, "pos", "col.*")
    pieces = pieces.where(~F.col("next").startswith(_LINE))  # a line's last piece ends, as does the text's
    pieces = pieces.select(doc, "pos", F.substring_index(F.ltrim("text", F.lit(_LINE)), " ", -1).alias("_last"), F.substring_index("next", " ", 1).alias("_first")).where(F.col("_last").rlike(_STOP))
    pieces = shaped(shaped(pieces, "_last", "a_"), "_first", "b_").where(F.col("a_stop").isin(".", "e"))
    key1 = F.when(F.col("a_stop") == ".", F.col("a_type")).otherwise(F.lit(""))
    open_ = pieces.select(doc, "pos", F.col("a_stop").alias("stop1"), key1.alias("key1"), F.col("b_type").alias("type2"), F.col("b_case").alias("case2"))
    known = open_.join(borders.decisions, ["key1", "stop1", "type2", "case2"], "left").join(borders.abbreviations.select(F.col("type").alias("key1"), F.lit(True).alias("_short")), "key1", "left")
    usual = (F.col("stop1") == ".") & F.col("_short").isNull()
    on = known.where(~F.coalesce("ends", usual)).groupBy(F.col(doc).alias("_doc")).agg(F.array_sort(F.collect_list("pos")).alias("_on"))
    # a flag for each piece up to the last one that goes on, so that each is looked up at its place
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("_on", i - 1))
    on = on.select("_doc", F.flatten(F.transform("_on", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - before(i) - 1), F.array(F.lit(True))))).alias("_goes_on"))
    whole = docs.select(F.col(doc), F.col(text_col).alias("_text")).join(on, F.col(doc).eqNullSafe(F.col("_doc")), "left")
    glued = F.transform(_pieces(F.col("_text")), lambda p, i: F.concat(F.ltrim(p, F.lit(_LINE)), F.when(F.get("_goes_on", i), F.lit(" ")).otherwise(F.lit(_CUT))))
    return whole.select(doc, F.filter(F.transform(F.split(F.array_join(glued, ""), _CUT), T.squeeze), lambda s: s != "").alias("sentences"))
