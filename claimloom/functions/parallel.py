"""Making use of all cores on small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer; larger inputs are not moved.

    For work that costs far more than a shuffle of its input, such as Python over texts of one small file.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
