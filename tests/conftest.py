import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def rows(frame):
    """Rows of a Spark, DuckDB or pandas frame, columns by name, as comparable text; the first two through Arrow, which keeps whole numbers whole beside nulls."""
    import datetime

    import pandas as pd

    def plain(x):
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return "null"
        if isinstance(x, datetime.datetime) and x.tzinfo:
            x = x.astimezone(datetime.timezone.utc).replace(tzinfo=None)
        return repr(x.item() if hasattr(x, "item") else x)

    arrow = frame.toArrow() if hasattr(frame, "toArrow") else frame.to_arrow_table() if hasattr(frame, "to_arrow_table") else None
    if arrow is None:
        frame = frame[sorted(frame.columns)]
        return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))
    columns = [map(plain, arrow.column(n).to_pylist()) for n in sorted(arrow.column_names)]
    return sorted(zip(*columns, strict=True))
