"""Streaming twins of ingestion: deliveries arrive as files and are taken in once each.

Every stream keeps its progress, its state and its rows in a folder that the caller names; run again
with the same folder it goes on where it stopped, also after a failure in the middle of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.durable import file_system


def deliveries(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a delivery log, a folder or a single file, with the schema that they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    fs, place = file_system(spark, path)
    if fs.getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def first_wins(stream: DataFrame, record_id: str, columns: list[str], folder: str, within: str | None = None) -> DataFrame:
    """The table of records taken in: of each the first delivery that came; rows without an id are left out.

    Takes in all that is there and stops. The ids taken in are Spark's own state, partitioned by id, so a
    batch costs what it holds and not what came before. With ``within`` (such as '30 days') an id is kept only
    until event time has passed its first delivery by that: the state is bounded, deliveries later than that
    are dropped, and so are rows without a time. Without it all ids are kept.
    """
    rows = stream.where(F.col(record_id).isNotNull())
    if within:
        rows = rows.where("received_at IS NOT NULL").withWatermark("received_at", within).dropDuplicatesWithinWatermark([record_id])
    else:
        rows = rows.dropDuplicates([record_id])
    taken = rows.select(record_id, *columns)
    taken.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(taken.schema).parquet(f"{folder}/rows")


def daily_counts(stream: DataFrame, folder: str, delay: str = "3650 days") -> DataFrame:
    """``day, n_rows``: deliveries per day of receipt, by event time.

    Days older than the newest delivery by ``delay`` are closed: their state goes and later rows of them are
    dropped. Each batch writes the days that it changed in place of what was written of them before, so a
    batch that runs again changes nothing. Rows without a time are left out.
    """
    counts = stream.where("received_at IS NOT NULL").withWatermark("received_at", delay).groupBy(F.window("received_at", "1 day").alias("w")).agg(F.count("*").alias("n_rows"))
    days = counts.select("n_rows", F.date_format("w.start", "yyyy-MM-dd").alias("day"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/rows")

    days.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(days.schema).parquet(f"{folder}/rows").select("day", "n_rows")
