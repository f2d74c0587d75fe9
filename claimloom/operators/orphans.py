"""References to records that do not exist, by sorted arrays per key range.

Keys are reduced to the distinct ones before they move, so a key that a third of all rows refer to
is one row. Live parents and referenced keys are range-partitioned together by a hash of the key;
each range holds its parents as a sorted array, in which batches of references are looked up by
binary search. Only the missing keys go back to the referring rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import key


@dataclass(frozen=True)
class Reference:
    """``table.field`` refers to ``parent.parent_key``; ``record_id`` names the referring record."""

    table: str
    record_id: str
    field: str
    parent: str
    parent_key: str


#: The references of this data.
REFERENCES = (
    Reference("source_claims", "claim_id", "source_id", "sources", "source_id"),
    Reference("source_claims", "claim_id", "created_by_run_id", "processing_runs", "run_id"),
    Reference("claim_locators", "locator_id", "claim_id", "source_claims", "claim_id"),
    Reference("review_batch_rows", "review_row_id", "review_batch_id", "review_batches", "review_batch_id"),
)


def live_parents(tables: dict[str, DataFrame], deletions: DataFrame, references: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """``parent, key`` of every live record: received, and not deleted since it was last received."""
    parts = [deletions.select(F.col("record_table").alias("parent"), key("record_id").alias("key"), F.lit(None).cast("timestamp").alias("received"), F.col("deleted_at").alias("deleted"), F.lit(False).alias("there"))]
    for parent, column in dict.fromkeys((r.parent, r.parent_key) for r in references):
        parts.append(tables[parent].select(F.lit(parent).alias("parent"), key(column).alias("key"), F.col("received_at").alias("received"), F.lit(None).cast("timestamp").alias("deleted"), F.lit(True).alias("there")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return (
        rows.where("key IS NOT NULL")
        .groupBy("parent", "key")
        .agg(F.max("received").alias("received"), F.max("deleted").alias("deleted"), F.bool_or("there").alias("there"))
        .where("there AND (deleted IS NULL OR received > deleted)")
        .select("parent", "key")
    )


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by parent table, parents before references, and hash: gives the keys not found."""
    of, hashes, keys, last = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("parent").dictionary_encode()
        for code, name in enumerate(names.dictionary.to_pylist()):
            rows = batch.filter(pc.equal(names.indices, code))
            if name != of:
                of, hashes, keys, last = name, [], [], None
            refs = rows.column("is_ref").to_numpy(zero_copy_only=False)
            old = rows.filter(pa.array(~refs))
            if old.num_rows:
                hashes.append(old.column("hash").to_numpy())
                keys.append(old.column("key"))
            new = rows.filter(pa.array(refs))
            if not new.num_rows:
                continue
            if last is None:  # all parents of this range have come
                last = (np.concatenate([*hashes, np.empty(0, np.int64)]), pa.chunked_array(keys, pa.string()))
            sorted_hashes, sorted_keys = last
            wanted, want_keys = new.column("hash").to_numpy(), new.column("key")
            found = np.zeros(len(wanted), bool)
            at, end = np.searchsorted(sorted_hashes, wanted, "left"), np.searchsorted(sorted_hashes, wanted, "right")
            while (open_ := (at < end) & ~found).any():  # keys of equal hash are told apart by themselves
                rows_open = np.flatnonzero(open_)
                hit = pc.equal(sorted_keys.take(pa.array(at[rows_open])), pa.chunked_array([want_keys.take(pa.array(rows_open))]))
                found[rows_open] = np.asarray(hit.to_numpy(), bool)
                at = at + open_
            lost = new.filter(pa.array(~found))
            if lost.num_rows:
                yield lost.select(["parent", "key"])


def missing_keys(referred: DataFrame, live: DataFrame) -> DataFrame:
    """The ``parent, key`` pairs of ``referred`` that ``live`` lacks."""
    both = referred.select("parent", "key", F.lit(True).alias("is_ref")).distinct().unionByName(live.select("parent", "key", F.lit(False).alias("is_ref")))
    ranged = both.withColumn("hash", F.xxhash64("key")).repartitionByRange("parent", "hash").sortWithinPartitions("parent", "is_ref", "hash")
    return ranged.mapInArrow(_probe, "parent string, key string")


def orphans(tables: dict[str, DataFrame], deletions: DataFrame, references: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """Dead references: ``table_name, field_name, record_id, key, received_at`` (first receipt).

    A NULL or blank value is no reference; case and white space around a key do not matter; a parent
    received later counts. Redelivered records count once. Empty tables give no rows, or leave all
    references to them dead.
    """
    parts = [
        tables[r.table].select(F.lit(r.table).alias("table_name"), F.lit(r.field).alias("field_name"), F.col(r.record_id).alias("record_id"), F.lit(r.parent).alias("parent"), key(r.field).alias("key"), "received_at").where("key IS NOT NULL")
        for r in references
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    missing = missing_keys(rows.select("parent", "key"), live_parents(tables, deletions, references))
    return rows.join(missing, ["parent", "key"]).groupBy("table_name", "field_name", "record_id", "key").agg(F.min("received_at").alias("received_at"))


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Counts per table, field and month of receipt; records without a receipt fall under NULL."""
    return found.groupBy("table_name", "field_name", F.date_format("received_at", "yyyy-MM").alias("month")).agg(F.count_distinct("record_id").alias("n_records"), F.count_distinct("key").alias("n_keys"))
