"""Keyword search: BM25 over an inverted index that is written once.

The index is a folder of postings, partitioned by a hash of the term and sorted by term within, so that a
query reads the partitions and row groups of its own words alone.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import unaccent, words

#: Fixed values of the ranking function.
K1, B = 1.2, 0.75
#: Words that are operators in a query.
OPERATORS = ("and", "or", "not", "near")
#: Words by which an index is not probed.
STOP_WORDS = ("the", "and", "was", "for", "with", "that", "this", "from")
#: Partitions of the postings by a hash of the term.
BUCKETS = 64


def tokens(x: Column) -> Column:
    """Runs of letters and digits, in lower case, without accents."""
    return F.regexp_extract_all(F.lower(unaccent(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """The words of a query that must all occur; raises where there are none."""
    flat = "".join(c for c in unicodedata.normalize("NFD", query) if unicodedata.category(c) != "Mn").lower()
    terms = [w for w in re.findall(r"[^\W_]+", flat) if w not in OPERATORS]
    if not terms:
        raise ValueError("the query has no words")
    return list(dict.fromkeys(terms))


def indexed(df: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """``record_id, terms``: the tokens of all fields of each record; NULL fields have none."""
    return df.select(F.col(record_id).alias("record_id"), tokens(F.concat_ws("\n", *fields)).alias("terms"))


def postings(index: DataFrame) -> DataFrame:
    """``term, record_id, tf``."""
    return index.select("record_id", F.explode("terms").alias("term")).groupBy("term", "record_id").agg(F.count("*").alias("tf"))


def term_stats(posts: DataFrame) -> DataFrame:
    """``term, n_records, n_occurrences``."""
    return posts.groupBy("term").agg(F.count("*").alias("n_records"), F.sum("tf").alias("n_occurrences"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS))


def write_index(index: DataFrame, folder: str) -> str:
    """Write the postings of ``index`` with their records' lengths, and the number and total length of records; returns the folder.

    A term that a third of all records have is spread over tasks and files by its records.
    """
    lengths = index.select("record_id", F.size("terms").alias("dl"))
    rows = postings(index).join(lengths, "record_id").withColumn("bucket", _bucket(F.col("term")))
    rows.repartitionByRange("bucket", "term", "record_id").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")
    lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).write.parquet(f"{folder}/records")
    return folder


def bm25(spark: SparkSession, folder: str, query: str, limit: int | None = 20) -> DataFrame:
    """``record_id, score`` of the records of an index that have all words of a query, best first.

    The score is negative as the better match is the lesser one; ties go by id. ``limit`` is that of the
    result list; None gives all.
    """
    terms = query_terms(query)
    schema = "term string, record_id string, tf bigint, dl int, bucket bigint"
    posts = spark.read.schema(schema).parquet(f"{folder}/postings").where(F.col("bucket").isin(*(_bucket(F.lit(t)) for t in terms)) & F.col("term").isin(*terms))
    often = posts.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has words
    records = spark.read.schema("n bigint, total bigint").parquet(f"{folder}/records").select("n", F.try_divide("total", "n").alias("avgdl"))  # one row
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = -idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = posts.join(often.join(F.broadcast(records)), "term").groupBy("record_id").agg(F.sum(part).alias("score"), F.count("*").alias("k")).where(F.col("k") == len(terms)).select("record_id", "score")
    return found.orderBy("score", "record_id").limit(limit) if limit else found


def probe_words(text: Column) -> Column:
    """The first three words of a text by which its index is probed: letters and digits only, over two, no stop words."""
    clean = F.transform(F.slice(words(text), 1, 3), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+", ""))
    return F.filter(clean, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOP_WORDS))


def reindexed(posts: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after the records of ``changed`` (an index) were taken out and put in anew; doing it twice changes nothing."""
    return posts.join(changed.select("record_id").distinct(), "record_id", "left_anti").select("term", "record_id", "tf").unionByName(postings(changed))
