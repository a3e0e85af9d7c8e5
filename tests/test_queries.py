"""Every registered query against its SQL, and those without SQL against their row counts or a plain model."""

import pytest

from conftest import SF, rows
from ragloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    found, wanted = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    asked = sum(r[0] % 100 == 0 for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect())
    assert entry.entry(spark).count() == 5 * asked > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
