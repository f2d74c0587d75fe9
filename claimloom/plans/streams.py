"""Queries that run as streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.functions.durable import temporary
from claimloom.sources.tables import table
from claimloom.streaming import ingest


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    table(spark, d, name)
    return ingest.deliveries(spark, f"{d}/{name}.parquet")


def stream1_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Claims taken in once each from a stream of deliveries."""
    return ingest.first_wins(_stream(spark, d, "source_claims"), "claim_id", ["source_id", "claim_type"], temporary(spark, "stream"))


def stream2_daily(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of claims per day of receipt, by event time."""
    return ingest.daily_counts(_stream(spark, d, "source_claims"), temporary(spark, "stream"))


QUERIES = {f.__name__: f for f in (stream1_first_wins, stream2_daily)}
SQL = {
    "stream1_first_wins": "SELECT DISTINCT claim_id, source_id, claim_type FROM source_claims",
    "stream2_daily": "SELECT strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n_rows FROM source_claims GROUP BY 1",
}
