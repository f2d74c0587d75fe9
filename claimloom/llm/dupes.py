"""Collapsing records that differ only in formatting, with Bloom filters of what repeats.

A first pass hashes the canonical form of every record into two Bloom filters per partition: hashes
seen once and hashes seen again. Merged over partitions, a bit that two partitions have set in 'once'
belongs to 'again' as well. Only records found in the merged 'again' filter can have copies; they alone
are shuffled and grouped exactly. All others are single.

A filter is an array of 64-bit words; a hash sets four bits of one word, so that filters travel as
their non-zero words. Its size is at most ``MAX_WORDS`` words (32 MB), whatever the data: beyond that
size it only lets more singles through to the exact step. That bound allows broadcasting it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.durable import written
from claimloom.functions.text import WS

MAX_WORDS = 1 << 22
SEGMENT = 1 << 12


def canonical(x: Column) -> Column:
    """Without white space, letter case and punctuation (category P, but a mark directly between two digits stays)."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"(?<![0-9])\p{P}|\p{P}(?![0-9])", ""), WS, ""))


def claims_of_payloads(raw: DataFrame) -> DataFrame:
    """``raw_id, source_quote, faithful_paraphrase`` of JSON payloads: one claim, bare or alone in ``claims``.

    Unreadable payloads, and lists of none or several, are left out.
    """
    one = "source_quote STRING, faithful_paraphrase STRING"
    p = F.from_json("payload", f"{one}, claims ARRAY<STRUCT<{one}>>, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    claim = F.when(F.col("p.claims").isNull(), F.struct("p.source_quote", "p.faithful_paraphrase")).when(F.size("p.claims") == 1, F.get("p.claims", 0))
    rows = raw.select("raw_id", p.alias("p")).where("p IS NOT NULL AND p._bad IS NULL")
    return rows.select("raw_id", claim.alias("c")).where("c IS NOT NULL").select("raw_id", "c.source_quote", "c.faithful_paraphrase")


def keyed(df: DataFrame, table: str, record_id: str, fields: list[str]) -> DataFrame:
    """``table_name, record_id, h, digest``: a 64-bit hash for the filters and a 256-bit digest for the exact step.

    NULL is a value that only equals NULL. Rows without an id are left out.
    """
    parts = [x for f in fields for x in (F.coalesce(canonical(F.col(f)), F.lit("")), F.when(F.col(f).isNull(), "\x01").otherwise("\x02"))]
    joined = F.concat(F.lit(table), F.lit("\x00"), *parts)
    rows = df.where(F.col(record_id).isNotNull()).select(F.lit(table).alias("table_name"), F.col(record_id).alias("record_id"), joined.alias("c"))
    return rows.select("table_name", "record_id", F.xxhash64("c").alias("h"), F.unhex(F.sha2("c", 256)).alias("digest"))


def _masks(h: np.ndarray) -> np.ndarray:
    h, one = h.view(np.uint64), np.uint64(1)
    mask = np.zeros(len(h), np.uint64)
    for shift in (40, 46, 52, 58):
        mask |= one << ((h >> np.uint64(shift)) & np.uint64(63))
    return mask


def _build(words: int):
    """Partition function: hashes in, the non-zero words of both filters out, by segment."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for b in batches:
            h, n = np.unique(b.column(0).to_numpy(), return_counts=True)
            if not len(h):
                continue
            word, mask = (h & (words - 1)).astype(np.int64), _masks(h)
            order = np.argsort(word, kind="stable")
            word, mask, twice = word[order], mask[order], n[order] > 1
            # Hashes of one word go in one after another: the first of each word, then the second, ...
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.arange(len(word)) - np.repeat(first, np.diff(np.r_[first, len(word)]))
            for r in range(rank.max() + 1):
                at = rank == r
                w, m = word[at], mask[at]
                seen = twice[at] | ((once[w] & m) == m)
                again[w[seen]] |= m[seen]
                once[w] |= m
        used = np.flatnonzero(once)
        if len(used):
            ends = np.flatnonzero(np.r_[used[1:] // SEGMENT != used[:-1] // SEGMENT, True]) + 1
            parts = [used[a:e] for a, e in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(p[0] // SEGMENT) for p in parts], pa.int32()),
                    pa.array([(p % SEGMENT).astype(np.uint16).tobytes() for p in parts], pa.binary()),
                    pa.array([once[p].tobytes() for p in parts], pa.binary()),
                    pa.array([again[p].tobytes() if again[p].any() else b"" for p in parts], pa.binary()),
                ],
                ["segment", "at", "once", "again"],
            )

    return partition


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All partitions' parts of some segments in, the merged 'again' words of each out."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for segment, at, o, a in zip(*(b.column(c).to_pylist() for c in ("segment", "at", "once", "again")), strict=True):
            once, again = held.setdefault(segment, (np.zeros(SEGMENT, np.uint64), np.zeros(SEGMENT, np.uint64)))
            i, o = np.frombuffer(at, np.uint16), np.frombuffer(o, np.uint64)
            again[i] |= once[i] & o
            if a:
                again[i] |= np.frombuffer(a, np.uint64)
            once[i] |= o
    some = [(s, again) for s, (_, again) in held.items() if again.any()]
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.int32()), pa.array([x.view(np.int64) for _, x in some], pa.list_(pa.int64()))], ["segment", "words"])


def filter_words(n_rows: int) -> int:
    """A power of two of words for about 16 bits a record, within the bound."""
    return min(MAX_WORDS, max(SEGMENT, 1 << max(0, (n_rows // 4 - 1).bit_length())))


def possible_repeats(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` with ``repeats``: False only where no other row can have the same hash ``h``."""
    filters = rows.select("h").mapInArrow(_build(words), "segment int, at binary, once binary, again binary")
    again = filters.repartition("segment").mapInArrow(_merge, "segment int, words array<bigint>")
    h = F.col("h")
    word = h.bitwiseAND(F.lit(words - 1))
    mask = F.expr("shiftleft(1L, CAST(shiftrightunsigned(h, 40) & 63 AS INT)) | shiftleft(1L, CAST(shiftrightunsigned(h, 46) & 63 AS INT)) | shiftleft(1L, CAST(shiftrightunsigned(h, 52) & 63 AS INT)) | shiftleft(1L, CAST(shiftrightunsigned(h, 58) & 63 AS INT))")
    probed = rows.withColumns({"segment": F.floor(word / SEGMENT).cast("int"), "_word": (word % SEGMENT).cast("int"), "_mask": mask})
    joined = probed.join(F.broadcast(again), "segment", "left")  # at most MAX_WORDS words in all
    hit = F.get("words", F.col("_word")).bitwiseAND(F.col("_mask")) == F.col("_mask")
    return joined.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("repeats"))


def _groups(rows: DataFrame) -> DataFrame:
    """Members of exact groups: ``table_name, digest, record_id``, each record once."""
    return rows.where("repeats").select("table_name", "digest", "record_id").distinct()


def copies(rows: DataFrame, n_rows: int) -> DataFrame:
    """``table_name, record_a, record_b``: the smallest id of each group of copies with each other one.

    ``rows`` as from :func:`keyed`. The smallest ids are found by partial aggregation; a group that
    holds a third of all records is one row there, and its members stay spread over their scans or the
    splits of a skewed join.
    """
    members = written(_groups(possible_repeats(rows, filter_words(n_rows))), "members")
    least = members.groupBy("table_name", "digest").agg(F.min("record_id").alias("record_a"), F.max("record_id").alias("_most")).where("record_a < _most").drop("_most")
    return members.join(least, ["table_name", "digest"]).where("record_id <> record_a").select("table_name", "record_a", F.col("record_id").alias("record_b"))


def collapsed(rows: DataFrame, n_rows: int) -> DataFrame:
    """``table_name, record_id, n_copies``: one row per different record, the smallest id standing for its copies."""
    split = possible_repeats(rows, filter_words(n_rows))
    grouped = _groups(split).groupBy("table_name", "digest").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n_copies")).drop("digest")
    return split.where("NOT repeats").select("table_name", "record_id", F.lit(1).cast("bigint").alias("n_copies")).unionByName(grouped)
