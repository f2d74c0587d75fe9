"""One local session for all tests, and the given tables in DuckDB."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-tests-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = str(ROOT)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test data here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.fixture(scope="session")
def same():
    """Compares rows of both engines, whatever their order."""

    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 9) if isinstance(v, float) else str(v)

    def rows(columns, values):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted((tuple(plain(v[i]) for i in order) for v in values), key=str)

    def check(df, con, sql):
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())

    return check
