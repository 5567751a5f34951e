import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def _plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def same_rows(duck):
    """Compare a DataFrame's rows with those of a DuckDB query, whatever their order."""

    def compare(df, sql):
        cols = sorted(df.columns)
        got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        assert got == want

    return compare
