"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import ann, bpe, crf, importance, jaccard, language, lexical, licenses, mix, prefixes, private, quality, substrings

#: Token budget of op6 and share of a toxic verdict of op10.
TOKEN_LIMIT, TOXIC_FROM = 4096, 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_lines(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.similar_classes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False))
    model = language.learnt(docs.where(~held))
    out = language.identify(docs.select("doc_id", "text", held.alias("held_out")), model, carry=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix.mixed(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.repeated_passages(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = prefixes.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id", "n_bytes"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _digested(batches):
    """Digests of the ids (decimal, joined by commas) and of the decoded bytes."""
    for batch in batches:
        ids, decoded = [], []
        for x in batch.column("ids"):
            ids.append(hashlib.sha256(",".join(map(str, np.asarray(x.values).tolist())).encode()).hexdigest())
        for x in batch.column("decoded"):
            decoded.append(hashlib.sha256(x.as_buffer()).hexdigest())
        sizes = batch.column("ids").value_lengths().cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id with the size and digest of the text's ids, and the digest of the bytes they decode to.

    The encoder's and decoder's batches feed each other in one Python stage, so that ids and bytes never cross to the JVM.
    """
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    to_ids, to_bytes = bpe.encoding(path, pattern, "text", "ids"), bpe.decoding(path, pattern, "ids", "decoded")
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _digested(to_bytes(to_ids(batches))), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    seen = _fold("doc_id", 3) != 1
    field = crf.learnt(docs.where(seen), labels.where(seen))
    out = crf.score(docs, field, carry=["doc_id"], spans=None)
    held = F.coalesce(_fold("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op11_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = private.found(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in private.KINDS]
    base, spans = (F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",") for c in ("base", "spans"))
    return out.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_nearest": op9_nearest,
    "op10_toxicity": op10_toxicity,
    "op11_private_spans": op11_private_spans,
    "op12_lexical_search": op12_lexical_search,
    "op13_importance": op13_importance,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.SQL,
    "op2_jaccard_join": jaccard.SQL,
    "op4_mix_sources": mix.SQL,
    "op5_substring_dedup": substrings.SQL,
    "op7_quality_rules": quality.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_importance": importance.SQL,
}
