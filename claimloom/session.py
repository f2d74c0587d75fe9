"""Settings of a session, from the environment where they differ between places."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What the plans rely on: adaptive execution with skew splitting, one time zone, and codes for lost executors left to Spark.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Few bytes can be much work (texts compared with texts): small partitions are kept apart while cores are free.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Ids that a stream has taken in lie on disk and are saved by what changed, not kept whole in memory.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(name: str = "claimloom", **more: str) -> SparkSession:
    """The running session, or a new one; ``CLAIMLOOM_MASTER`` and ``CLAIMLOOM_CHECKPOINT_DIR`` apply if set."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    if os.environ.get("CLAIMLOOM_MASTER"):
        builder = builder.master(os.environ["CLAIMLOOM_MASTER"])
    if os.environ.get("CLAIMLOOM_CHECKPOINT_DIR"):
        builder = builder.config("spark.checkpoint.dir", os.environ["CLAIMLOOM_CHECKPOINT_DIR"])
    return builder.getOrCreate()
