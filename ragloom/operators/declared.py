"""Declared tables: keys, defaults and checks that rows must hold, compiled into plain expressions.

One pass of map-side work flags each row's breaches; a key's first row comes from one aggregate of the key and its order,
so that a key with a third of all rows costs no task of its own. What breaks a rule is kept apart with the rules' names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.operators.lasting import lasting


@dataclass
class Declared:
    """Columns (a schema in which what is not nullable must be there), defaults and checks as SQL expressions, the key, and the column by which a key's first row wins."""

    schema: T.StructType
    key: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    first: str | None = None

    def filled(self, rows: DataFrame) -> DataFrame:
        """The declared columns in their types, nulls and missing columns by their defaults. Other columns are left out."""

        def one(f: T.StructField) -> Column:
            value = F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
            return (F.coalesce(value, F.expr(self.defaults[f.name]).cast(f.dataType)) if f.name in self.defaults else value).alias(f.name)

        return rows.select(*(one(f) for f in self.schema))

    def _rules(self) -> dict[str, Column]:
        """What breaks each rule; an unknown check counts as broken."""
        needed = dict.fromkeys([f.name for f in self.schema if not f.nullable] + self.key)
        return {f"{c} is missing": F.col(c).isNull() for c in needed} | {name: ~F.coalesce(F.expr(x), F.lit(False)) for name, x in self.checks.items()}

    def judged(self, rows: DataFrame) -> DataFrame:
        """The filled rows with `breaches`, the names of the rules that each breaks, in the order of the declaration.

        Of the rows that break nothing else and share a key, the first by `first` (of equal ones, the least by the other
        columns) holds it; the others break the rule `key`. Wholly equal rows count once: their copies break it as well.
        """
        names = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in self._rules().items()), F.lit(None).cast("string")))
        out = self.filled(rows).withColumn("breaches", names)
        if not self.key:
            return out
        good = F.size("breaches") == 0
        order = F.struct(*([self.first] if self.first else []), *(f.name for f in self.schema if f.name not in self.key))
        # a number apart for equal rows, which only decides between them; written, so that both uses below see one
        out = lasting(out.withColumn("_at", F.when(good, F.struct(order.alias("o"), F.monotonically_increasing_id().alias("i")))))
        held = out.where(good).groupBy(*(F.col(c).alias(f"_k_{c}") for c in self.key)).agg(F.min("_at").alias("_first"))
        both = out.join(held, [F.col(c) == F.col(f"_k_{c}") for c in self.key], "left")
        late = F.col("_at").isNotNull() & (F.col("_at") != F.col("_first"))
        return both.select(*self.schema.fieldNames(), F.when(late, F.array(F.lit("key"))).otherwise(F.col("breaches")).alias("breaches"))

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that break nothing, the others with their breaches)."""
        out = self.judged(rows)
        return out.where(F.size("breaches") == 0).drop("breaches"), out.where(F.size("breaches") > 0)

    def report(self, rows: DataFrame) -> DataFrame:
        """(rule, n): the rows that break each rule, 0 for those that none breaks; one aggregate over the judged rows."""
        rules = [*self._rules(), *(["key"] if self.key else [])]
        sums = self.judged(rows).agg(*(F.coalesce(F.sum(F.array_contains("breaches", r).cast("long")), F.lit(0)).alias(f"r{i}") for i, r in enumerate(rules)))
        return sums.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("n")) for i, r in enumerate(rules)))).alias("x")).select("x.*")
