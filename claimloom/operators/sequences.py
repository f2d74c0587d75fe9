"""Running counts over ordered groups of any size.

A group that holds a third of all rows is not one window: rows are range-partitioned by group and
order, counted within the partition, and the counts of earlier partitions of the group (at most as many
as there are partitions) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions.durable import written


def running_count(df: DataFrame, group: list[str], order: list[str], mark: Column, name: str) -> DataFrame:
    """``df`` with ``name``: how many rows of the group up to this one have ``mark`` true.

    ``order`` must make rows distinct for a defined result; rows equal in it lie in one partition.
    """
    placed = written(df.withColumn("_mark", F.coalesce(mark.cast("int"), F.lit(0))).repartitionByRange(*group, *order).withColumn("_block", F.spark_partition_id()), "sequence")
    within = F.sum("_mark").over(W.partitionBy("_block", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    sums = placed.groupBy(*group, "_block").agg(F.sum("_mark").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    seams = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_block").alias("_b"), earlier.alias("_before")).where("_before > 0")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    on = F.col("_block") == F.col("_b")
    for s in same:
        on = on & s
    counted = placed.withColumn("_within", within).join(seams, on, "left")
    return counted.select(*df.columns, (F.col("_within") + F.coalesce("_before", F.lit(0))).alias(name))


def numbering(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in its group, from 1."""
    return running_count(df, group, order, F.lit(True), name)
