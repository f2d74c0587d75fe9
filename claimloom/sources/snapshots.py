"""Versioned snapshots of tables: written whole, listed in a manifest, checked against it.

A version is a folder of Parquet tables with a manifest of row counts and digests. Pointer files name the
current version: each new one has the next number and appears by a rename, and the greatest holds. So a
write that fails at any point leaves the version before in force, and there is always a current one.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.durable import file_system
from claimloom.operators.digests import table_digest
from claimloom.operators.merging import imported

_MANIFEST = "table_name string, n_rows bigint, digest_a string, digest_b string"


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows, digest_a, digest_b`` of each table."""
    return reduce(DataFrame.unionByName, [table_digest(df, name, df.columns) for name, df in tables.items()])


def write(tables: dict[str, DataFrame], root: str) -> str:
    """Write a version under ``root`` and make it current; returns its name."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    stored = {name: spark.read.schema(df.schema).parquet(f"{root}/{version}/{name}") for name, df in tables.items()}
    manifest(stored).coalesce(1).write.json(f"{root}/{version}/manifest")
    fs, staged = file_system(spark, f"{root}/{version}/pointer")
    out = fs.create(staged, True)
    out.write(json.dumps({"version": version, "tables": sorted(tables)}).encode())
    out.close()
    number = max((n for n, _ in _pointers(spark, root)), default=0) + 1
    # Where another writer took the number, the file that is there stays.
    while fs.exists(target := file_system(spark, f"{root}/current-{number:012d}.json")[1]) or not fs.rename(staged, target):
        number += 1
    return version


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    fs, place = file_system(spark, root)
    names = (s.getPath().getName() for s in fs.listStatus(place) if s.isFile())
    return sorted((int(n[8:-5]), n) for n in names if n.startswith("current-") and n.endswith(".json"))


def current(spark: SparkSession, root: str) -> tuple[str, list[str]]:
    """The name and the tables of the version in force."""
    row = spark.read.schema("version string, tables array<string>").option("multiLine", "true").json(f"{root}/{_pointers(spark, root)[-1][1]}").first()
    return row.version, row.tables


def versions(spark: SparkSession, root: str) -> list[str]:
    fs, place = file_system(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory())


def read(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    version = version or current(spark, root)[0]
    fs, place = file_system(spark, f"{root}/{version}")
    names = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory())
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names if n != "manifest"}


def check(spark: SparkSession, root: str) -> DataFrame:
    """``table_name, problem`` for the current version: NULL where a table agrees with the manifest."""
    version, _ = current(spark, root)
    want = spark.read.schema(_MANIFEST).json(f"{root}/{version}/manifest")
    got = manifest(read(spark, root)).select(F.col("table_name").alias("t"), *(F.col(c).alias(f"_{c}") for c in ("n_rows", "digest_a", "digest_b")))
    rows = want.join(got, F.col("table_name") == F.col("t"), "full_outer")
    problem = F.when(F.col("t").isNull(), "missing").when(F.col("table_name").isNull(), "unlisted").when(F.col("n_rows") != F.col("_n_rows"), "row count").when((F.col("digest_a") != F.col("_digest_a")) | (F.col("digest_b") != F.col("_digest_b")), "content")
    return rows.select(F.coalesce("table_name", "t").alias("table_name"), problem.alias("problem"))


def rebuild(spark: SparkSession, packages: list[str], keys: dict[str, list[str]], target: str) -> DataFrame:
    """A new version at ``target`` from several packages, each a root of versions; returns ``table_name, n_rows, n_conflicts``.

    All packages are checked first: one whose tables do not agree with its manifest stops everything, and
    the target stays as it was; one without any version is passed over. Then each table takes every key once,
    from the first package that has it; ``keys`` names the key of each table.
    """
    there = [p for p in packages if file_system(spark, p)[0].exists(file_system(spark, p)[1]) and _pointers(spark, p)]
    for p in there:
        bad = check(spark, p).where("problem IS NOT NULL").first()  # one row
        if bad:
            raise ValueError(f"{p}: {bad.table_name}: {bad.problem}")
    if not there:
        raise ValueError("no package has a version")
    stored = [read(spark, p) for p in there]
    merged = {}
    for name in sorted({n for s in stored for n in s}):
        parts = [s[name].withColumn("_package", F.lit(i)) for i, s in enumerate(stored) if name in s]
        merged[name] = imported(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts), keys[name], ["_package"])
    version = write({n: df.drop("_package", "n_rows", "is_conflict") for n, df in merged.items()}, target)
    assert version == current(spark, target)[0]
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n_rows"), F.count_if("is_conflict").alias("n_conflicts")).select(F.lit(n).alias("table_name"), "n_rows", "n_conflicts") for n, df in merged.items()])
