"""Five stages from raw documents to encoded training text; each works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import bpe, jaccard, language, mix, substrings
from ragloom.llm.scratch import drop, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language centroid is near enough to; the rest, null and letterless texts go. Learns from the rows of its own input."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}  # apart from the columns that the model adds
    out = language.identify(docs.select(*(F.col(c).alias(n) for c, n in names.items())), language.learnt(docs), names["text"])
    return out.where(~F.col("rejected")).select(*(F.col(n).alias(c) for c, n in names.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect: the one of the smallest id."""
    return jaccard.first_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; texts of which nothing is left go. n_chars follows the text."""
    out = substrings.without_passages(docs)
    out = out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mix.repeated(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `ids`, `n_tokens` and `round_trip`, whether the ids decode to the text; columns so named are replaced."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")]
    names = {c: f"d{i}" for i, c in enumerate(kept)}  # apart from the columns that the encoder adds
    out = bpe.round_trip(docs.select(*(F.col(c).alias(n) for c, n in names.items())), path, pattern, text_col=names["text"])
    same = F.col("decoded") == F.coalesce(F.col(names["text"]), F.lit("")).cast("binary")
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: The classifier, the similarity join and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written as Parquet and read again, and deleted once the next one is there.

    Empty tables pass through all stages; rows with null ids or texts, repeated rows and further columns are kept or
    dropped as each stage says.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)
        before = docs
    return docs
