import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows_of(df):
    """Rows as comparable strings, columns in order of name; whole floats read as integers."""

    def norm(v):
        if v is None or v != v:
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else round(v, 6) if isinstance(v, float) else v

    columns = sorted(df.columns)
    if hasattr(df, "collect"):
        got = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    else:
        names = df.columns
        got = [tuple(norm(dict(zip(names, r, strict=True))[c]) for c in columns) for r in df.fetchall()]
    return columns, sorted(map(repr, got))
