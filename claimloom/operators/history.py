"""Histories of changing attributes by presence bitmaps.

The states of an entity form a sequence of snapshots. For each pair of entity and content the
snapshots that show it are bits of 64-bit words; runs of consecutive bits are the periods in which
the content was valid. A content that comes back later has two runs and needs no special case.

An entity with very many states is no single group: states are range-partitioned by entity and
instant, words are built within a partition, and only the seams between the partitions that one
entity spans (at most as many as there are partitions) are looked at across them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions.durable import written
from claimloom.functions.text import instant_us

#: The instant of the state before the first known change.
BEGINNING = -(2**63)
#: The attributes of a claim that its revisions change.
FIELDS = ("claim_type", "source_quote", "faithful_paraphrase", "evidence_basis_description")


def presence_runs(states: DataFrame) -> DataFrame:
    """The runs of equal content in each entity's sequence of states.

    ``states`` has ``entity``, ``us`` (BIGINT, one state per entity and instant), ``content``
    (compared by equality, not NULL). Returns ``entity, content, valid_from, valid_to``: one row per
    run, valid_to being the start of the next run or NULL. An empty input gives no rows.
    """
    # The block of a state is settled once, in a file, because range bounds are sampled.
    placed = written(states.select("entity", "us", "content").repartitionByRange("entity", "us").withColumn("block", F.spark_partition_id()), "states")
    at = W.partitionBy("block", "entity")
    indexed = placed.withColumn("i", F.row_number().over(at.orderBy("us")) - 1)
    bit = F.col("i") % 64
    words = (
        indexed.withColumn("bit", bit)
        .groupBy("block", "entity", F.floor(F.col("i") / 64).alias("word"), "content")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.collect_list(F.struct("bit", "us")).alias("when"))
    )
    # A run goes on over the end of a word if the word before it ended with the same content ...
    same = W.partitionBy("block", "entity", "content").orderBy("word")
    words = words.withColumn("carried", F.coalesce((F.lag("word").over(same) == F.col("word") - 1) & (F.lag("bits").over(same) < 0), F.lit(False)))
    # ... and over the end of a block if that ended with it.
    lasts = placed.groupBy("block", "entity").agg(F.max_by("content", "us").alias("last"))
    seams = lasts.withColumn("before", F.lag("last").over(W.partitionBy("entity").orderBy("block"))).where("before IS NOT NULL").select("block", "entity", "before", F.lit(0).cast("bigint").alias("word"))
    words = words.join(seams, ["block", "entity", "word"], "left").withColumn("carried", F.col("carried") | F.coalesce(F.col("before") == F.col("content"), F.lit(False)))
    starts = F.expr("bits & ~(shiftleft(bits, 1) | CASE WHEN carried THEN 1L ELSE 0L END)")
    runs = (
        words.withColumn("starts", starts)
        .select("block", "entity", "content", F.explode(F.expr("filter(when, w -> (shiftright(starts, w.bit) & 1) = 1)")).alias("w"))
        .select("block", "entity", "content", F.col("w.us").alias("valid_from"))
    )
    firsts = runs.groupBy("block", "entity").agg(F.min("valid_from").alias("first"))
    later = firsts.select("block", "entity", F.min("first").over(W.partitionBy("entity").orderBy("block").rowsBetween(1, W.unboundedFollowing)).alias("later")).where("later IS NOT NULL")
    return (
        runs.withColumn("next", F.lead("valid_from").over(at.orderBy("valid_from")))
        .join(later, ["block", "entity"], "left")
        .select("entity", "content", "valid_from", F.coalesce("next", "later").alias("valid_to"))
    )


def content_key(struct: Column) -> Column:
    """Equal for equal values of all fields, whatever the JSON looked like; NULL differs from ''."""
    return F.md5(F.to_json(struct))


def revision_states(revisions: DataFrame) -> DataFrame:
    """What each instant of change left in force: ``claim_id, us, before, after`` (content structs).

    Redelivered revisions count once. Revisions of one claim at one instant form a path from content
    to content; its ends are the contents that more revisions leave than reach, and the reverse. A
    path without ends came back to where it began: that instant changes nothing and is left out, unless
    its revisions hold a single content, which then is in force. Left out are also rows without claim,
    without a readable instant, or whose new content is no readable JSON object.
    """
    schema = ", ".join(f"{f} STRING" for f in FIELDS) + ", _bad STRING"
    read = lambda c: F.from_json(c, schema, {"columnNameOfCorruptRecord": "_bad"})
    edges = (
        revisions.select("revision_id", "claim_id", instant_us("created_at").alias("us"), read("previous_content_json").alias("p"), read("new_content_json").alias("n"))
        .where("claim_id IS NOT NULL AND us IS NOT NULL AND n IS NOT NULL AND n._bad IS NULL")
        .select("revision_id", "claim_id", "us", *(F.struct(*(F.col(f"{x}.{f}").alias(f) for f in FIELDS)).alias(x) for x in "pn"))
        .withColumns({"pk": content_key(F.col("p")), "nk": content_key(F.col("n"))})
        .groupBy("revision_id", "claim_id", "us", "pk", "nk")
        .agg(F.any_value("p").alias("p"), F.any_value("n").alias("n"))
    )
    ends = edges.select("claim_id", "us", F.explode(F.array(F.struct(F.col("pk").alias("k"), F.col("p").alias("c"), F.lit(-1).alias("d")), F.struct(F.col("nk").alias("k"), F.col("n").alias("c"), F.lit(1).alias("d")))).alias("e"))
    nodes = ends.groupBy("claim_id", "us", F.col("e.k").alias("k")).agg(F.sum("e.d").alias("d"), F.any_value("e.c").alias("c"))
    first, last = F.struct("k", "c"), F.struct(-F.col("d"), F.col("k"))
    by = F.struct("d", "k")
    return nodes.groupBy("claim_id", "us").agg(F.min_by(first, by).alias("before"), F.min_by(first, last).alias("after"), F.max("d").alias("d"), F.count("*").alias("n")).where("d > 0 OR n = 1").drop("d", "n")


def claim_versions(revisions: DataFrame) -> DataFrame:
    """All versions of each claim: ``claim_id, content_key, valid_from_us, valid_to_us``.

    The content before the first revision is a version whose valid_from_us is NULL. A revision that
    leaves what was in force begins none. Claims without usable revisions have no rows.
    """
    return _versions(written(revision_states(revisions).select("claim_id", "us", "before.k", F.col("after.k").alias("after")).withColumnRenamed("k", "before"), "revisions"))


def _versions(states: DataFrame) -> DataFrame:
    """The versions from ``claim_id, us, before, after`` (content keys)."""
    base = states.groupBy("claim_id").agg(F.min_by("before", "us").alias("content")).select(F.col("claim_id").alias("entity"), F.lit(BEGINNING).alias("us"), "content")
    runs = presence_runs(base.unionByName(states.select(F.col("claim_id").alias("entity"), "us", F.col("after").alias("content"))))
    return runs.select(F.col("entity").alias("claim_id"), F.col("content").alias("content_key"), F.when(F.col("valid_from") != BEGINNING, F.col("valid_from")).alias("valid_from_us"), F.col("valid_to").alias("valid_to_us"))


def claim_history(revisions: DataFrame) -> DataFrame:
    """:func:`claim_versions` with the four values of each version."""
    states = written(revision_states(revisions), "contents")
    contents = states.select("claim_id", F.explode(F.array("before", "after")).alias("x")).groupBy("claim_id", F.col("x.k").alias("content_key")).agg(F.any_value("x.c").alias("c"))
    versions = _versions(states.select("claim_id", "us", F.col("before.k").alias("before"), F.col("after.k").alias("after")))
    return versions.join(contents, ["claim_id", "content_key"]).select("claim_id", "valid_from_us", "valid_to_us", *(F.col(f"c.{f}").alias(f) for f in FIELDS))
