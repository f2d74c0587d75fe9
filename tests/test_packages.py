"""Digests of whole tables, sets of tables, and rebuilding from packages."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import digests, merging
from claimloom.plans import packages
from claimloom.plans.joins import IDS, records
from claimloom.sources import snapshots
from tests.conftest import DATA


def test_any_column_changes_the_digest(spark):
    if not DATA.exists():
        pytest.skip("no test data here")
    for name in ("sources", "claim_locators"):
        df = records(spark, str(DATA), name).drop("received_at").cache()
        assert df.columns == packages.COLUMNS[name].split()
        digest = lambda x, name=name: digests.table_digest(x, name, x.columns).first()
        was = digest(df)
        least = df.agg(F.min(IDS[name])).first()[0]
        for c in df.columns:
            other = F.when(F.col(IDS[name]) == least, F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("7")).cast(df.schema[c].dataType)).otherwise(F.col(c))
            now = digest(df.withColumn(c, F.coalesce(other, F.lit("7").cast(df.schema[c].dataType))))
            assert now.n_rows == was.n_rows and (now.digest_a, now.digest_b) != (was.digest_a, was.digest_b), c


def test_sets_of_tables(spark):
    s = lambda rows, name: digests.summary(spark.createDataFrame(rows, "k string, v string"), name, "k", ["k", "v"])
    a = s([("1", "a"), ("2", None)], "same").union(s([("1", "a")], "more")).union(s([("1", "a")], "ids")).union(s([("1", None)], "content")).union(s([], "gone"))
    b = s([("2", None), ("1", "a")], "same").union(s([("1", "a"), ("1", "a")], "more")).union(s([("3", "a")], "ids")).union(s([("1", "")], "content")).union(s([], "new"))
    assert {tuple(r) for r in digests.compare_sets(a, b).collect()} == {("more", "count"), ("ids", "ids"), ("content", "content"), ("gone", "only in a"), ("new", "only in b")}


def test_first_package_wins(spark):
    rows = [(2, "1", "b", 1), (1, "1", "a", None), (1, "2", "x", 2), (3, "2", "x", 2), (2, "3", None, None), (3, "3", "", None)]
    df = spark.createDataFrame(rows, "p int, k string, v string, n int")
    got = {tuple(r) for r in merging.imported(df, ["k"], ["p"]).collect()}
    assert got == {(1, "1", "a", None, 2, True), (1, "2", "x", 2, 2, False), (2, "3", None, None, 2, True)}
    assert merging.imported(df.limit(0), ["k"], ["p"]).count() == 0


def test_rebuild(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "k string, v string")
    a, b, none, target = (f"file://{tmp_path}/{n}" for n in ("a", "b", "none", "target"))
    snapshots.write({"t": df([("1", "a"), ("2", "b")])}, a)
    version = snapshots.write({"t": df([("2", "other"), ("3", "c")]), "u": df([("1", None)])}, b)
    report = snapshots.rebuild(spark, [a, none, b], {"t": ["k"], "u": ["k"]}, target)
    assert {tuple(r) for r in report.collect()} == {("t", 3, 1), ("u", 1, 0)}
    got = snapshots.read(spark, target)
    assert {tuple(r) for r in got["t"].collect()} == {("1", "a"), ("2", "b"), ("3", "c")} and got["u"].count() == 1
    was = snapshots.current(spark, target)
    df([("2", "other"), ("3", "tampered")]).write.mode("overwrite").parquet(f"{b}/{version}/t")
    with pytest.raises(ValueError, match="content"):
        snapshots.rebuild(spark, [a, b], {"t": ["k"], "u": ["k"]}, target)
    assert snapshots.current(spark, target) == was
    with pytest.raises(ValueError, match="no package"):
        snapshots.rebuild(spark, [none], {}, target)
