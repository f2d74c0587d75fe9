"""Delivery logs: records that arrive more than once, late, or before what they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, record_id: str) -> DataFrame:
    """One row per record, the first received; rows without an id are left out, those without a time are last.

    Columns are aggregated one by one, so a query moves only those that it uses, and partial aggregation
    keeps a record that was delivered very often from being one large group. Deliveries of one record
    at one time are taken to be equal, as those of a delivery log are.
    """
    at = F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp"))
    rest = [c for c in df.columns if c not in (record_id, "received_at")]
    rows = df.where(F.col(record_id).isNotNull()).groupBy(record_id)
    return rows.agg(*(F.min_by(c, at).alias(c) for c in rest), F.min("received_at").alias("received_at")).select(*df.columns)


def new_only(incoming: DataFrame, present: DataFrame, record_id: str) -> DataFrame:
    """First wins: the first delivery of each record that is not present yet."""
    return once(incoming, record_id).join(present.select(record_id).distinct(), record_id, "left_anti").select(*incoming.columns)


def by_content(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, sha256, canonical_id, is_new``: equal contents get the least id of those that have it.

    The least ids are found by aggregation and joined back, so a content that a third of all records
    share is no single window. NULL texts are each their own content.
    """
    rows = df.select(F.col(record_id).alias("record_id"), F.sha2(text, 256).alias("sha256"))
    least = rows.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("record_id").alias("least"))
    out = rows.join(least, "sha256", "left").select("record_id", "sha256", F.coalesce("least", "record_id").alias("canonical_id"))
    return out.withColumn("is_new", F.col("canonical_id") == F.col("record_id"))
