"""Files and folders as sources: rules on binary files, annotations, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of a PDF file, what stands near its end, and the largest size in bytes.
MAGIC, TAIL, LARGEST = "%PDF-", "%%EOF", 100 * 1024 * 1024


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of files without content, which Spark's own scan passes over; only they are listed here."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []
    return spark.createDataFrame([(s.getPath().toString(), 0) for s in found if s.isFile() and s.getLen() == 0], "path string, length bigint")


def file_rules(spark: SparkSession, path: str, magic: str = MAGIC, tail: str = TAIL, largest: int = LARGEST) -> DataFrame:
    """``path, length, problem``: the first rule that each file breaks, or NULL.

    Rules: not empty, not larger than ``largest``, begins with ``magic``, has ``tail`` in its last 1024
    bytes. Files beyond the size are listed by their length alone; their content is not read.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    read = spark.read.format("binaryFile").load(path).where(F.col("length") <= largest).select("path", "content")
    end = F.substring("content", F.greatest(F.length("content") - 1023, F.lit(1)), F.lit(1024))
    checked = read.select("path", F.startswith("content", F.lit(magic.encode())).alias("begins"), F.contains(end, F.lit(tail.encode())).alias("ends"))
    rows = listed.join(checked, "path", "left").unionByName(_empty_files(spark, path), allowMissingColumns=True)
    problem = F.when(F.col("length") == 0, "empty").when(F.col("length") > largest, "too large").when(~F.col("begins"), "not of the kind").when(~F.col("ends"), "cut off")
    return rows.select("path", "length", problem.alias("problem"))


def annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Annotations of one JSON array (``.json``) or one object a line (``.jsonl``); blank lines are skipped."""
    reader = spark.read.schema(schema)
    return reader.json(path) if path.endswith(".jsonl") else reader.option("multiLine", "true").json(path)


def layouts(spark: SparkSession, paths: dict[str, str], renames: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Parquet folders of several layouts under one schema, with ``layout``; missing columns are NULL."""
    out = None
    for name, path in paths.items():
        df = spark.read.parquet(path).withColumnsRenamed((renames or {}).get(name, {})).withColumn("layout", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
