"""From rows to stored vectors, and from questions to answers with a status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import qa as Q
from ragloom.operators import retrieval as R
from ragloom.operators.keyed import KeyedTable

VECTORS = "id long, field string, vec array<float>"


def unpivoted(rows: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, text): a row for each field that is not blank."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.explode(parts).alias("x")).select("id", "x.field", "x.text").where(T.strip(F.col("text")) != "")


def unvectorised(rows: DataFrame, flag: str = "vector", content: str = "content") -> DataFrame:
    """Rows that have content and no vectors yet."""
    return rows.where((F.col(flag) == 0) & (F.octet_length(content) > 0))


def vectorised(rows: DataFrame, id_col: str, fields: tuple[str, ...], embed: Callable[[Column], Column], flag: str = "vector", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """((id, field, vec) of the rows without vectors, all rows with the flag set where there was content)."""
    made = unpivoted(unvectorised(rows, flag, content), id_col, fields).select("id", "field", embed(F.col("text")).cast("array<float>").alias("vec")).where("vec is not null")
    done = (F.col(flag) == 0) & F.coalesce(F.octet_length(content) > 0, F.lit(False))
    return made, rows.withColumn(flag, F.when(done, F.lit(1)).otherwise(F.col(flag)))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a vector table; an empty one where there is none yet."""
    stored = KeyedTable(spark, path)
    return stored.read() if stored.versions() else spark.createDataFrame([], VECTORS)


def write_vectors(vectors: DataFrame, path: str) -> int:
    """Puts vectors in place of those of equal (id, field), adds the others, and returns the version.

    Only the buckets that the vectors fall into are written anew; `KeyedTable.vacuum` deletes what no version needs.
    Of vectors that repeat a key the greatest stays.
    """
    stored = KeyedTable(vectors.sparkSession, path)
    stored.create(VECTORS, ["id", "field"])
    return stored.upsert(vectors).version


def questions(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """(query, question) of questions as they come in, numbered from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "query long, question string")


def question_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(question, asked_at) of text files that arrive in a folder, a question a line."""
    return spark.readStream.text(folder).select(F.col("value").alias("question"), F.current_timestamp().alias("asked_at"))


def search_fields(asked: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query, found): a map from field to the k nearest ids there, of (query, qvec) against (id, field, vec)."""
    return R.by_field(R.top_k_blocks(asked, vectors, k, by=("field",)))


def answered(asked: DataFrame, vectors: DataFrame, rows: DataFrame, chat: Q.Chat = Q.first_line, embed: Callable[[Column], Column] | None = None, k: int = 5) -> DataFrame:
    """(query, status, n_ids, answer, error) of questions (query, question, and qvec unless `embed` makes it).

    The ids nearest in any field are put together, their non-empty texts are the context, and the model answers from it.
    400: a blank question; 404: nothing found; 500: the model failed, with its message; else 200. `rows` is (id, content).
    """
    full = asked if embed is None else asked.withColumn("qvec", embed(F.col("question")))
    blank = F.coalesce(T.strip(F.col("question")), F.lit("")) == ""
    hits = R.top_k_blocks(full.where(~blank).select("query", "qvec"), vectors, k, by=("field",))
    found = R.fused(hits).join(R.context(hits, rows), "query", "left")
    full = full.select("query", "question", blank.alias("blank")).join(found, "query", "left")
    said = Q.asked(full.where("ids is not null").select("query", "question", "context"), Q.answer_messages(F.coalesce("context", F.lit("")), F.col("question")), chat=chat, error="error")
    out = full.select("query", "blank", F.size(F.coalesce("ids", F.array().cast("array<long>"))).alias("n_ids")).join(said.select("query", "answer", "error"), "query", "left")
    status = F.when(F.col("blank"), 400).when(F.col("n_ids") == 0, 404).when(F.col("error").isNotNull(), 500).otherwise(200)
    return out.select("query", status.alias("status"), "n_ids", "answer", "error")


def known_answers(asked: DataFrame, known: DataFrame, order: str, question: str = "question", answer: str = "answer") -> DataFrame:
    """The asked rows with `answer`, of the first known row of equal question by `order`, and `status`: 200, or 404 without one."""
    first = known.where(F.col(question).isNotNull()).groupBy(F.col(question).alias("_question")).agg(F.min_by(F.struct(F.col(answer).alias("a")), order).alias("_found"))
    out = asked.join(first, F.col(question) == F.col("_question"), "left")
    return out.withColumn("answer", F.col("_found.a")).withColumn("status", F.when(F.col("_found").isNull(), 404).otherwise(200)).drop("_question", "_found")


def titled_by_parent(files: DataFrame, urls: DataFrame, pages: DataFrame, url: str = "url", parent: str = "parents", html: str = "paragraph") -> DataFrame:
    """Files with `title`, that of the page which links to them, empty without one; urls is (url, parent), pages (url, html)."""
    of = urls.select(F.col(url).alias("_url"), F.col(parent).alias("_parent")).groupBy("_url").agg(F.min("_parent").alias("_parent"))
    titles = pages.groupBy(F.col(url).alias("_page")).agg(F.min(html).alias("_html")).select("_page", T.page_title(F.col("_html")).alias("_title"))
    out = files.join(of, F.col(url) == F.col("_url"), "left").join(titles, F.col("_parent") == F.col("_page"), "left")
    return out.withColumn("title", F.coalesce("_title", F.lit(""))).drop("_url", "_parent", "_page", "_title")


def with_leaves(docs: DataFrame, leaves: DataFrame, key: str, flag: str) -> DataFrame:
    """The documents with their flag set where the written leaves hold their key, so that leaves and flags cannot part."""
    has = leaves.select(F.col(key).alias("_key")).distinct()
    return docs.join(has, F.col(key) == F.col("_key"), "left").withColumn(flag, F.when(F.col("_key").isNotNull(), 1).otherwise(F.col(flag))).drop("_key")


def stored_contents(contents: DataFrame, urls: DataFrame, new: DataFrame, key: str = "url", flag: str = "content") -> tuple[DataFrame, DataFrame]:
    """(contents with the new rows of unknown keys, urls with their flag set where contents hold the key)."""
    both = contents.unionByName(new.join(contents.select(key), key, "left_anti").select(*contents.columns))
    return both, with_leaves(urls, both, key, flag)
