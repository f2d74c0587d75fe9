"""Digests of rows and of whole tables.

A table's digest is the number of its rows and sums of slices of their hashes: it does not depend on
order, needs no sort, and is combined from partial sums however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_row(columns: list[str]) -> Column:
    """All columns as text, by name, NULL marked."""
    return F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)))


def row_hash(columns: list[str]) -> Column:
    return F.sha2(canonical_row(columns), 256)


def short_hash(*parts: Column) -> Column:
    """The first 16 hex digits over parts joined by bars; NULL parts are left out."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def multiset_digest(h: Column) -> list[Column]:
    """Aggregates over hex hashes: count and two sums of 60-bit slices."""
    lane = lambda i: F.sum(F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(28,0)")).cast("string")
    return [F.count("*").alias("n_rows"), F.coalesce(lane(1), F.lit("0")).alias("digest_a"), F.coalesce(lane(16), F.lit("0")).alias("digest_b")]


def table_digest(df: DataFrame, name: str, columns: list[str], key: list[str] | None = None) -> DataFrame:
    """``table_name, n_rows, digest_a, digest_b`` over some columns (a content digest, or that of a key)."""
    return df.select(row_hash(key or columns).alias("h")).agg(*multiset_digest(F.col("h"))).select(F.lit(name).alias("table_name"), "n_rows", "digest_a", "digest_b")


def summary(df: DataFrame, name: str, key: str, columns: list[str]) -> DataFrame:
    """``table_name, n_rows, id_digest, content_digest`` in one pass: digests of the keys alone and of the columns."""
    rows = df.select(row_hash([key]).alias("i"), row_hash(columns).alias("h"))
    n, ids, contents = F.count("*").alias("n_rows"), multiset_digest(F.col("i"))[1], multiset_digest(F.col("h"))
    return rows.agg(n, ids.alias("id_digest"), F.concat_ws("-", contents[1], contents[2]).alias("content_digest")).select(F.lit(name).alias("table_name"), "n_rows", "id_digest", "content_digest")


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """``table_name, difference`` of two sets of tables by their :func:`summary` rows; tables that agree give no row.

    The first that holds: only in a, only in b, count, ids, content.
    """
    rows = a.select("table_name", F.struct("n_rows", "id_digest", "content_digest").alias("x")).join(b.select("table_name", F.struct("n_rows", "id_digest", "content_digest").alias("y")), "table_name", "full_outer")
    kind = F.when(F.col("y").isNull(), "only in a").when(F.col("x").isNull(), "only in b").when(F.col("x.n_rows") != F.col("y.n_rows"), "count").when(F.col("x.id_digest") != F.col("y.id_digest"), "ids").when(F.col("x.content_digest") != F.col("y.content_digest"), "content")
    return rows.select("table_name", kind.alias("difference")).where("difference IS NOT NULL")


def differences(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``key, change``: rows only in ``a`` (removed), only in ``b`` (added), or different (changed)."""
    x = a.select(*key, row_hash(columns).alias("ha"))
    y = b.select(*key, row_hash(columns).alias("hb"))
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed")
    return x.join(y, key, "full_outer").select(*key, change.alias("change")).where("change IS NOT NULL")
