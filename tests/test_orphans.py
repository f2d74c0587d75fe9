from datetime import datetime

from claimloom.operators.orphans import Reference, missing_keys, orphans, orphans_by_month

DAY = lambda n: datetime(2025, 1, n)
REF = (Reference("child", "id", "parent_id", "parent", "key"),)
CHILD = "id string, parent_id string, received_at timestamp, key string, parent string"


def run(spark, children, parents, gone=()):
    child = spark.createDataFrame([(*c, "clash", "clash") for c in children], CHILD)
    tables = {"child": child, "parent": spark.createDataFrame(parents, "key string, received_at timestamp, hash string")}
    return orphans(tables, spark.createDataFrame(list(gone), "record_table string, record_id string, deleted_at timestamp"), REF)


def test_cases(spark):
    children = [
        ("1", "P-a", DAY(1)), ("2", " p-A\t", DAY(1)), ("3", "P-x", DAY(1)), ("3", "P-x", DAY(2)), ("4", None, DAY(1)), ("5", "  ", DAY(1)),
        ("6", "P-gone", DAY(9)), ("7", "P-back", DAY(1)), ("8", "P-late", DAY(1)), ("9", "P", None), ("10", "P-again", DAY(1)),
    ]
    parents = [("P-a", DAY(1), "h"), ("P-gone", DAY(1), "h"), ("P-back", DAY(1), "h"), ("P-back", DAY(5), "h"), ("P-late", DAY(20), "h"), (None, DAY(1), "h"), ("P-again", DAY(4), "h")]
    gone = [("parent", "p-GONE ", DAY(3)), ("parent", "P-back", DAY(3)), ("other", "P-a", DAY(3)), ("parent", "P-again", DAY(2)), ("parent", "P-again", DAY(4)), ("parent", None, None)]
    got = run(spark, children, parents, gone)
    assert {r.record_id for r in got.collect()} == {"3", "6", "9", "10"}
    months = {(r.month, r.n_records) for r in orphans_by_month(got).collect()}
    assert months == {("2025-01", 3), (None, 1)}


def test_one_key_holds_most(spark):
    children = [(str(i), "HOT" if i % 3 else f"K{i}", DAY(1)) for i in range(3000)]
    parents = [(f"k{i}", DAY(1), None) for i in range(0, 3000, 6)]
    got = {r.record_id for r in run(spark, children, parents).collect()}
    assert got == {str(i) for i in range(3000) if i % 6}


def test_empty(spark):
    assert run(spark, [], []).count() == 0
    assert run(spark, [("1", "a", DAY(1))], []).count() == 1
    assert run(spark, [], [("a", DAY(1), None)]).count() == 0


def test_missing_keys_against_sets(spark):
    refs = [("t" if i % 2 else "u", f"k{i % 500}", "x") for i in range(2000)]
    live = [("t", f"k{i}") for i in range(0, 500, 3)]
    got = {tuple(r) for r in missing_keys(spark.createDataFrame(refs, "parent string, key string, extra string"), spark.createDataFrame(live, "parent string, key string")).collect()}
    assert got == {(p, k) for p, k, _ in refs} - set(live)
