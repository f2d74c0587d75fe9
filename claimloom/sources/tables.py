"""Reading the given tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import claimloom


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table by name; Python workers started from here on find this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(claimloom.__file__).parents[1]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
