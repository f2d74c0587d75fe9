"""What changed between consecutive full snapshots, by a window over each key's snapshots.

Each key's rows are first reduced to one per snapshot (partial aggregation before the shuffle), so
that a key's window is never longer than the list of snapshots. A hash that differs from the lagged
one is a change; a gap in the snapshot index is a removal and a later addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions.text import instant_us, strip

#: Columns compared as they are, and statuses, whose case and surrounding white space do not matter.
PLAIN, STATUSES = ("source_id", "claim_type", "author_hedging"), ("record_review_status", "quote_match_status")


def _fingerprint(columns: list[Column]) -> Column:
    """128 bits over values of which NULL is one."""
    parts = [x for c in columns for x in (c.isNull(), F.coalesce(c, F.lit("")))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def snapshot_changes(rows: DataFrame, plain: tuple[str, ...] = PLAIN, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """``snapshot_id, claim_id, change_type`` (added, removed, changed) against the snapshot before.

    Snapshots are ordered by ``taken_at``, then id; the first gives no rows. Within a snapshot the row
    of the latest ``updated_at`` holds (an unreadable one is the earliest; among equal ones the
    greatest fingerprint holds). Rows without snapshot or claim id are left out.
    """
    rows = rows.where("snapshot_id IS NOT NULL AND claim_id IS NOT NULL")
    names = rows.groupBy("snapshot_id").agg(F.min("taken_at").alias("taken_at"))
    every = W.orderBy("taken_at", "snapshot_id")  # one row per snapshot
    index = names.select("snapshot_id", F.row_number().over(every).alias("i"), F.count("*").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("last"))
    held = (
        rows.withColumns({"h": _fingerprint([*(F.col(c) for c in plain), *(F.lower(strip(c)) for c in statuses)]), "us": F.coalesce(instant_us("updated_at"), F.lit(-(2**63)))})
        .groupBy("snapshot_id", "claim_id")
        .agg(F.max(F.struct("us", "h")).alias("held"))
        .join(index, "snapshot_id")
    )
    by_key = W.partitionBy("claim_id").orderBy("i")
    seen = held.select("claim_id", "i", "last", F.col("held.h").alias("h"), F.lag("i").over(by_key).alias("pi"), F.lag("held.h").over(by_key).alias("ph"), F.lead("i").over(by_key).alias("ni"))
    event = lambda when, i, kind: F.when(when, F.struct(i.alias("i"), F.lit(kind).alias("change_type")))
    i, pi, ni = F.col("i"), F.col("pi"), F.col("ni")
    events = F.array_compact(
        F.array(
            event((i > 1) & (pi.isNull() | (pi < i - 1)), i, "added"),
            event((pi == i - 1) & (F.col("h") != F.col("ph")), i, "changed"),
            event((i < F.col("last")) & (ni.isNull() | (ni > i + 1)), i + 1, "removed"),
        )
    )
    return seen.select("claim_id", F.explode(events).alias("e")).select("claim_id", F.col("e.i").alias("i"), F.col("e.change_type").alias("change_type")).join(index, "i").select("snapshot_id", "claim_id", "change_type")
