"""Applying logged changes to a table: each change once, in order, without a transaction log.

The result is a new DataFrame; writing it as a new version and then pointing to that is the commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_change(changes: DataFrame, key: str, change_id: str, order: list[str], values: list[str]) -> DataFrame:
    """``key, n_changes`` and the values of each key's last change by ``order``, then id.

    Redelivered changes (same id) count once. Only the greatest row per key survives partial aggregation,
    so a key with very many changes is no large group.
    """
    once = changes.where(F.col(key).isNotNull() & F.col(change_id).isNotNull()).groupBy(key, change_id).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"), F.max(F.struct(*order)).alias("o"))
    return once.groupBy(key).agg(F.count("*").alias("n_changes"), F.max_by("v", F.struct("o", change_id)).alias("v")).select(key, "n_changes", *(F.col(f"v.{c}").alias(c) for c in values))


def upsert(base: DataFrame, changed: DataFrame, key: str, columns: list[str], add: bool = False) -> DataFrame:
    """``base`` with the columns of ``changed`` where it has the key; with ``add`` also the keys that are new.

    ``changed`` has one row per key. A change to NULL is a change.
    """
    new = changed.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    rows = base.join(new, F.col(key) == F.col("_key"), "full_outer" if add else "left")
    value = lambda c: F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in columns else F.col(c)
    return rows.select(*((F.coalesce(F.col(key), F.col("_key")) if c == key else value(c)).alias(c) for c in base.columns))


def first_per(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per key, the least by ``order``: an insert that ignores keys already present."""
    rows = df.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return rows.select(*key, *(F.col(f"r.{c}").alias(c) for c in columns))


def imported(packages: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key of several packages of a table: that of the first package by ``order``, as first wins.

    Columns are those of ``packages``, then ``n_rows`` and ``is_conflict``, whether any other row of the key
    differs in a column outside of ``order``. A key with very many rows is reduced before it moves.
    """
    rest = [c for c in packages.columns if c not in (*key, *order)]
    content = F.xxhash64(*sorted(rest)) if rest else F.lit(0)
    rows = packages.withColumn("_c", content).groupBy(*key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order, F.col("_c"))).alias("r"), F.count("*").alias("n_rows"), (F.min("_c") != F.max("_c")).alias("is_conflict"))
    return rows.select(*(F.col(c) if c in key else F.col(f"r.{c}") for c in packages.columns), "n_rows", "is_conflict")
