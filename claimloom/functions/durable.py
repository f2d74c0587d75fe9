"""Cutting lineage with files that every executor can read.

The folder comes from ``spark.checkpoint.dir``; only where the session names none and runs on one machine
(as in tests) is a folder of this machine used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this process that are still there.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, setting one of our own only if none is configured.

    On a cluster a folder must be configured: what one executor wrote to its own disk no other could read.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share, as the master is {master}")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-claimloom-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there goes by :func:`release`, or when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, place = file_system(spark, path)
    fs.deleteOnExit(place)
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all temporary files made so far; returns of how many paths.

    For long sessions, once results are written or collected: DataFrames made before can be read no more.
    """
    n = len(_MADE)
    while _MADE:
        fs, place = file_system(spark, _MADE.pop())
        fs.delete(place, True)
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    What follows is planned from the file, so that an executor lost later costs a re-read and not the work
    before it. The job runs at once, while the query is being built.
    """
    path = temporary(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
