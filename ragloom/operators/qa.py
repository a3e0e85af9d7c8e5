"""Questions, answers and their evaluation, with any chat model as a plain callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ragloom.functions import scoring as S
from ragloom.functions import vectors as V

Chat = Callable[[list[dict[str, str]]], str]


def first_line(messages: list[dict[str, str]]) -> str:
    """The offline model: the first line of the last message."""
    return messages[-1]["content"].split("\n", 1)[0]


def asked(df: DataFrame, messages: Column, into: str = "answer", chat: Chat = first_line, error: str | None = None) -> DataFrame:
    """`into`: the model's reply to each row's messages (array of role and content), in batches.

    A failure is its message, or where `error` names a column, a null reply with the message there.
    """
    names = df.columns
    full = df.withColumn("_messages", messages)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            replies, errors = [], []
            for said in part["_messages"]:
                try:
                    replies.append(chat([{"role": m["role"], "content": m["content"]} for m in said]))
                except Exception as e:  # noqa: BLE001 - a model's failure is that row's answer
                    replies.append(f"error: {e}" if error is None else None)
                    errors += [None] * (len(replies) - 1 - len(errors)) + [str(e)]
            errors += [None] * (len(replies) - len(errors))
            yield part[names].assign(**{into: replies} | ({error: errors} if error else {}))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{into}` string", *([f"`{error}` string"] if error else [])])
    return full.mapInPandas(run, schema)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def answer_messages(context: Column, question: Column, instruction: str = "Answer only from the context.") -> Column:
    """System instruction, then context and question."""
    return F.array(_message("system", F.lit(instruction)), _message("user", F.concat(context, F.lit("\n\n"), question)))


def question_messages(passage: Column, instruction: str = "Write one question and its answer about the passage.") -> Column:
    return F.array(_message("system", F.lit(instruction)), _message("user", passage))


def judge_messages(context: Column, question: Column, answer: Column) -> Column:
    """Asks for a mark from 0 to 10."""
    return F.array(_message("system", F.lit("Mark the answer from 0 to 10.")), _message("user", F.concat_ws("\n", answer, context, question)))


def link_answer_messages(link: Column, question: Column, instruction: str = "Answer the question from the page at the link.") -> Column:
    return F.array(_message("system", F.lit(instruction)), _message("user", F.concat_ws("\n", link, question)))


def link_question_messages(link: Column, instruction: str = "Write one question that the page at the link answers.") -> Column:
    return F.array(_message("user", F.concat_ws("\n", F.lit(instruction), link)))


def topic_messages(subject: Column, count: int = 5) -> Column:
    """Asks for so many topics of a subject, one a line."""
    return F.array(_message("system", F.lit(f"Name {count} topics, one a line.")), _message("user", subject))


def connectivity_messages() -> Column:
    """The least that a working endpoint replies to."""
    return F.array(_message("user", F.lit("Hello")))


def highlight_prompt(passage: Column, part: Column) -> Column:
    """Asks for a question that the highlighted part of a passage answers: its first occurrence between marks; without one, the passage alone."""
    at = F.instr(passage, part)
    marked = F.concat(F.substr(passage, F.lit(1), at - 1), F.lit("<hl>"), part, F.lit("<hl>"), F.substr(passage, at + F.length(part)))
    return F.concat(F.lit("generate question: "), F.when((at > 0) & (part != ""), marked).otherwise(passage))


def site_query(question: Column, site: str) -> Column:
    """A web search for the question within one site."""
    return F.concat(F.lit(f"site:{site} "), question)


def chat_turns(turns: DataFrame, chat_id: str, order: str, said: str, reset: str = "reset") -> DataFrame:
    """Each turn with `messages`: those of the same chat since the last reset, itself included; resets themselves are left out."""
    at = Window.partitionBy(chat_id).orderBy(order)
    cut = turns.withColumn("_part", F.sum((F.col(said) == reset).cast("int")).over(at))
    since = Window.partitionBy(chat_id, "_part").orderBy(order)
    out = cut.where(F.col(said) != reset).withColumn("messages", F.collect_list(_message("user", F.col(said))).over(since))
    return out.drop("_part")


def mark(reply: Column) -> Column:
    """The first number of a judge's reply, at most 10; null without one."""
    number = F.nullif(F.regexp_extract(reply, r"([0-9]+(?:[.][0-9]+)?)", 1), F.lit(""))
    return F.when(number.isNotNull(), F.least(number.cast("double"), F.lit(10.0)))


def sampled(passages: DataFrame, id_col: str, n: int = 60) -> DataFrame:
    """n rows in an order that ids alone decide, so that a rerun takes the same."""
    return passages.orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(n)


def evaluated(rows: DataFrame, answer: str, reference: str, ids: str, relevant: str, answer_vector: str, reference_vector: str) -> DataFrame:
    """bleu, rouge_l, bert_score, cosine, recall_at_k and map_at_k, to 4 places; bert_score is the cosine of whole texts, as is cosine."""
    near = F.round(V.cosine(F.col(answer_vector), F.col(reference_vector)), 4)
    return rows.select(
        "*",
        F.round(S.bleu(F.col(answer), F.col(reference)), 4).alias("bleu"),
        F.round(S.rouge_l(F.col(answer), F.col(reference)), 4).alias("rouge_l"),
        near.alias("bert_score"),
        near.alias("cosine"),
        S.recall_at_k(F.col(ids), F.col(relevant)).alias("recall_at_k"),
        F.round(S.reciprocal_rank(F.col(ids), F.col(relevant)), 4).alias("map_at_k"),
    )


@F.pandas_udf(ArrayType(DoubleType()))
def _bag(places: pd.Series, size: pd.Series) -> pd.Series:
    """How often each place occurs, as a vector of unit length; none of no places."""
    out: list = [None] * len(places)
    for i, (x, n) in enumerate(zip(places, size, strict=True)):
        if x is not None and len(x):
            counts = np.bincount(np.asarray(x, np.int64), minlength=n).astype(float)
            out[i] = counts / np.sqrt(np.dot(counts, counts))
    return pd.Series(out, dtype=object)


def hashed_places(text: Column, size: int = 64) -> Column:
    """The place of each word in the vector of the offline encoder."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """The offline encoder: a bag of hashed words, of unit length; a blank text has no vector."""
    return _bag(hashed_places(text, size), F.lit(size))
