"""Keyed tables on files: hash buckets under versioned manifests.

A table is a folder of Parquet parts and of manifests. A manifest names, for each bucket of keys, the folder that holds
its rows; a version is complete when its manifest is there. An upsert reads and rewrites the buckets that its rows fall
into and no others, then commits a manifest that differs in these. Manifests are put in place by a link or rename that
fails if the name is taken, so of two writers one takes a version; the other takes the next one as it is if their
buckets differ, and merges again if not. Batches of a stream carry a name and number, and a repeated one does nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table; tries of a commit.
BUCKETS, TRIES = 64, 10


class Taken(Exception):
    """A version that another writer has committed meanwhile."""


@dataclass
class Manifest:
    version: int
    key: list[str]
    buckets: int
    schema: T.StructType
    parts: dict[int, str] = field(default_factory=dict)  # bucket to folder, below the table's
    batches: dict[str, int] = field(default_factory=dict)  # last batch of each stream

    def text(self) -> str:
        return json.dumps({"key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue(), "parts": self.parts, "batches": self.batches})

    @classmethod
    def of(cls, version: int, text: str) -> Manifest:
        x = json.loads(text)
        return cls(version, x["key"], x["buckets"], T.StructType.fromJson(x["schema"]), {int(k): v for k, v in x["parts"].items()}, x["batches"])


class KeyedTable:
    """A table at `path`, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    # manifests

    def versions(self) -> list[int]:
        folder = self._at("manifests")
        names = [s.getPath().getName() for s in self.files.listStatus(folder)] if self.files.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The latest manifest, or that of a version; none where there is no table yet."""
        found = self.versions()
        if version is None and not found:
            return None
        at = found[-1] if version is None else version
        stream = self.files.open(self._at(f"manifests/{at:012d}"))
        try:
            return Manifest.of(at, self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: Manifest) -> None:
        """Puts the manifest at its version, or raises Taken; nobody sees it in parts."""
        draft, last = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"manifests/{manifest.version:012d}")
        self.files.mkdirs(self._at("manifests"))
        out = self.files.create(draft)
        out.write(bytearray(manifest.text().encode()))
        out.close()
        try:
            if self.files.getUri().getScheme() == "file":  # a local rename replaces what is there, a link does not
                nio = self.jvm.java.nio.file
                place = lambda p: nio.Paths.get(self.files.makeQualified(p).toUri())
                nio.Files.createLink(place(last), place(draft))
            else:
                none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri()).rename(draft, last, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Taken(manifest.version) from e
            raise
        finally:
            self.files.delete(draft, False)

    # rows

    def create(self, schema: T.StructType | str, key: list[str], buckets: int = BUCKETS) -> Manifest:
        """The table's first manifest; of several writers one makes it, and all get that."""
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if self.manifest() is None:
            try:
                self.commit(Manifest(0, list(key), buckets, T.StructType([T.StructField(f.name, f.dataType) for f in kind])))
            except Taken:
                pass
        return self.manifest()

    def _bucket(self, manifest: Manifest) -> Column:
        return F.pmod(F.xxhash64(*manifest.key), F.lit(manifest.buckets)).cast("int")

    def _rows(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{p}" for b, p in sorted(manifest.parts.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(manifest.schema).parquet(*paths) if paths else self.spark.createDataFrame([], manifest.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"no table at {self.path}")
        return self._rows(found)

    def _merged(self, manifest: Manifest, rows: DataFrame, touched: list[int], update: list[str] | None, newest: str | None) -> DataFrame:
        names = manifest.schema.fieldNames()
        new = rows.select(*(F.col(c).cast(manifest.schema[c].dataType).alias(c) for c in names))
        rest = [c for c in names if c not in manifest.key]
        by = F.struct(*([newest] if newest else []), *(c for c in rest if c != newest))
        new = new.groupBy(*manifest.key).agg(F.max(by).alias("_n")) if rest else new.distinct()
        new = new.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(manifest.key)), *(F.col(f"_n.{c}").alias(f"_n_{c}") for c in rest), F.lit(True).alias("_new"))
        old = self._rows(manifest, touched).withColumn("_old", F.lit(True))
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(manifest.key)]
        both = old.join(new, same, "full_outer")
        takes = F.col("_new").isNotNull()
        if newest:
            takes = takes & (F.col("_old").isNull() | F.col(newest).isNull() | (F.col(f"_n_{newest}") >= F.col(newest)))
        pick = lambda c: F.when(F.col("_old").isNull() | (takes if update is None or c in update else F.lit(False)), F.col(f"_n_{c}")).otherwise(F.col(c))
        keys = {c: F.when(F.col("_old").isNull(), F.col(f"_k{i}")).otherwise(F.col(c)) for i, c in enumerate(manifest.key)}
        return both.select(*((keys[c] if c in keys else pick(c)).alias(c) for c in names))

    def upsert(self, rows: DataFrame, update: list[str] | None = None, newest: str | None = None, batch: tuple[str, int] | None = None) -> Manifest:
        """The manifest after the rows are in: new keys whole, known ones in the columns of `update` (all by default).

        With `newest`, a row replaces one that is not newer by that column. Of rows that repeat a key the greatest stays.
        Null keys are keys like others. A `batch` (stream, number) that is in already changes nothing.
        """
        seen: dict[int, str] = {}
        for _ in range(TRIES):
            now = self.manifest()
            if now is None:
                raise ValueError(f"no table at {self.path}")
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                return now
            if not seen or any(now.parts.get(b) != was for b, was in before.items()):
                touched = sorted(r["b"] for r in rows.select(self._bucket(now).alias("b")).distinct().collect())  # at most `buckets`
                before, seen = {b: now.parts.get(b) for b in touched}, {-1: ""}
                if touched:
                    name = f"data/{uuid.uuid4().hex}"
                    out = self._merged(now, rows, touched, update, newest).withColumn("_bucket", self._bucket(now))
                    # dealt by bucket, large buckets over several tasks
                    out.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
                    seen |= {b: f"{name}/_bucket={b}" for b in touched}
            parts = now.parts | {b: p for b, p in seen.items() if b >= 0}
            try:
                made = Manifest(now.version + 1, now.key, now.buckets, now.schema, parts, now.batches | ({batch[0]: batch[1]} if batch else {}))
                self.commit(made)
                return made
            except Taken:
                continue
        raise Taken(f"no version was free in {TRIES} tries")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last `keep` versions and the data that none of these names; the number of folders deleted.

        Not to be run beside writers: what they have not committed yet is named by no version.
        """
        versions = self.versions()
        held = {p.split("/")[1] for v in versions[-keep:] for p in self.manifest(v).parts.values()}
        for v in versions[:-keep]:
            self.files.delete(self._at(f"manifests/{v:012d}"), False)
        data = self._at("data")
        gone = [s.getPath() for s in self.files.listStatus(data) if s.getPath().getName() not in held] if self.files.exists(data) else []
        for p in gone:
            self.files.delete(p, True)
        return len(gone)
