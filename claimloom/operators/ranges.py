"""Joins of points with the ranges that hold them, by equality alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, end: str) -> DataFrame:
    """Each point with every range of equal ``keys`` that holds it, both ends included; columns of both.

    A range lies in one or two buckets as wide as itself, rounded up to a power of two, however long it
    is; a point looks into one bucket for each width that ranges of its keys have. Ranges that end before
    they start hold nothing, nor do those with an end missing; points without a value lie in none.
    """
    sized = ranges.where(F.col(start) <= F.col(end)).withColumn("_level", F.ceil(F.log2(F.col(end).cast("bigint") - F.col(start) + 1)).cast("int"))
    sides = F.array(*(F.expr(f"shiftright(CAST(`{c}` AS BIGINT), _level)") for c in (start, end)))
    buckets = sized.withColumn("_bucket", F.explode(F.array_distinct(sides)))
    levels = sized.select(*keys, "_level").distinct()
    looked = points.where(F.col(point).isNotNull()).join(levels, keys).withColumn("_bucket", F.expr(f"shiftright(CAST(`{point}` AS BIGINT), _level)"))
    return looked.join(buckets, [*keys, "_level", "_bucket"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_level", "_bucket")
