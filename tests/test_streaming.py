from datetime import datetime

from claimloom.streaming import ingest

SCHEMA = "id string, v string, received_at timestamp"


def test_first_wins_over_files(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    write([("1", "a", datetime(2025, 1, 1)), ("2", "b", datetime(2025, 1, 1)), ("1", "late", datetime(2025, 1, 3))])
    write([("2", "again", datetime(2025, 1, 2)), ("3", "c", datetime(2025, 1, 2)), (None, "x", None)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    rows = [tuple(r) for r in ingest.first_wins(stream, "id", ["v"], f"{tmp_path}/a").collect()]
    assert {r[0] for r in rows} == {"1", "2", "3"} and len(rows) == 3 and ("1", "a") in rows
    days = {tuple(r) for r in ingest.daily_counts(ingest.deliveries(spark, f"{tmp_path}/log"), f"{tmp_path}/b").collect()}
    assert days == {("2025-01-01", 2), ("2025-01-02", 2), ("2025-01-03", 1)}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    taken = lambda name="a", **kw: sorted(tuple(r) for r in ingest.first_wins(ingest.deliveries(spark, f"{tmp_path}/log"), "id", ["v"], f"{tmp_path}/{name}", **kw).collect())
    days = lambda: {tuple(r) for r in ingest.daily_counts(ingest.deliveries(spark, f"{tmp_path}/log"), f"{tmp_path}/d", "10 days").collect()}
    write([("1", "a", datetime(2025, 1, 1)), ("2", "b", datetime(2025, 1, 1)), (None, "x", datetime(2025, 1, 1))])
    assert taken() == [("1", "a"), ("2", "b")] and days() == {("2025-01-01", 3)}
    assert taken() == [("1", "a"), ("2", "b")] and days() == {("2025-01-01", 3)}
    write([("1", "again", datetime(2025, 1, 2)), ("3", "c", None), ("4", "d", datetime(2025, 2, 1))])
    assert taken() == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")]
    assert days() == {("2025-01-01", 3), ("2025-01-02", 1), ("2025-02-01", 1)}
    write([("5", "too late", datetime(2025, 1, 2)), ("6", "f", datetime(2025, 2, 1))])
    assert days() == {("2025-01-01", 3), ("2025-01-02", 1), ("2025-02-01", 2)}
    assert taken("w", within="40 days")[0] == ("1", "a")


def test_no_stream_but_a_schema(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/log")
    assert ingest.first_wins(ingest.deliveries(spark, f"{tmp_path}/log"), "id", ["v"], f"{tmp_path}/a").count() == 0
