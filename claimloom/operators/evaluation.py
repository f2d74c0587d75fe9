"""Conformance of extracted claims with annotations: best matches, metrics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.durable import written
from claimloom.functions.text import collapse, trimmed
from claimloom.operators.containment import least_covering, whole_in

#: Hedging words, found as substrings; the least percentages of the gate, and the share of words of a match.
HEDGES = ("may", "might", "could", "suggest", "potential", "possibly", "likely", "appears", "indicate")
THRESHOLDS = {"recall": 80, "type_accuracy": 85, "hedging_preservation": 95, "scope_preservation": 90, "quote_match": 100, "locator_completeness": 100}
SHARE = 0.7


def has_hedging(x: Column) -> Column:
    found = F.lit(False)
    for w in HEDGES:
        found = found | F.contains(F.lower(x), F.lit(w))
    return F.coalesce(found, F.lit(False))


def best_matches(annotations: DataFrame, claims: DataFrame) -> DataFrame:
    """``annotation_id, claim_id``: the least claim id among those whose quote holds the annotation's quote or 70 % of its words.

    Words have more than two characters, stand anywhere in the claim's quote and count each time; case
    does not matter. Quotes without such words are only looked for as a whole. Both inputs have ``source_quote``.
    """
    a = annotations.select(F.col("annotation_id").alias("id"), trimmed(F.lower("source_quote")).alias("quote")).where("quote <> ''")
    a = a.withColumn("words", F.filter(F.split(collapse("quote"), " "), lambda w: F.length(w) > 2))
    # A claim that holds the whole quote holds all its words.
    a = written(a.withColumn("need", F.ceil(F.size("words") * SHARE - 1e-9)), "targets")
    c = claims.select(F.col("claim_id").alias("id"), trimmed(F.lower("source_quote")).alias("text"))
    found = least_covering(a.select("id", "words", "need"), c)
    short = a.where(F.size("words") == 0)
    if not short.isEmpty():
        once = whole_in(short.select(F.col("quote").alias("id"), "quote").distinct(), c).groupBy(F.col("target_id").alias("quote")).agg(F.min("candidate_id").alias("candidate_id"))
        found = found.unionByName(short.join(once, "quote").select(F.col("id").alias("target_id"), "candidate_id"))
    return found.groupBy(F.col("target_id").alias("annotation_id")).agg(F.min("candidate_id").alias("claim_id"))


def unsupported(annotations: DataFrame, claims: DataFrame) -> DataFrame:
    """``claim_id`` of claims whose stripped quote is no positive annotation's and holds no negative one's; blank quotes are skipped."""
    # Numbers stand for ids and quotes in what is exploded into words.
    quote, no = trimmed("source_quote").alias("quote"), F.monotonically_increasing_id().alias("no")
    a = written(annotations.select("must_extract", quote).where("quote <> ''").distinct().select("*", no), "quotes")
    left = claims.select("claim_id", quote).where("quote <> ''").join(a.where("must_extract").select("quote"), "quote", "left_anti")
    left = written(left.select("claim_id", "quote", no), "left")
    holds = whole_in(a.where("NOT must_extract").select(F.col("no").alias("id"), "quote"), left.select(F.col("no").alias("id"), F.col("quote").alias("text")))
    return left.join(holds.select(F.col("candidate_id").alias("no")), "no", "left_anti").select("claim_id")


def percent(part: Column, whole: Column) -> Column:
    """A percentage to one decimal; 100 where there is nothing to count."""
    return F.when(whole == 0, 100.0).otherwise(F.round(part * 100 / whole, 1))


def metrics(annotations: DataFrame, claims: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of counts: what was expected and what was met, per property."""
    some = lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    # Of the texts only what is asked about them goes through the joins.
    c = claims.select("claim_id", (trimmed(F.coalesce("source_quote", F.lit(""))) != "").alias("cq"), F.col("claim_type").alias("ct"), F.col("page").isNotNull().alias("cp"), (some("author_hedging") | has_hedging(F.col("faithful_paraphrase"))).alias("ch"), some("scope_description").alias("cs"))
    a = annotations.select("annotation_id", "must_extract", "claim_type", *(some(x).alias(x) for x in ("source_quote", "author_hedging", "scope_description")))
    rows = a.join(matches, "annotation_id", "left").join(c, "claim_id", "left")
    pos, hit = F.col("must_extract"), F.col("claim_id").isNotNull()
    n = lambda x: F.count_if(x)
    return rows.agg(
        n(pos).alias("positives"), n(~pos).alias("negatives"), n(pos & hit).alias("recall_n"), n(~pos & hit).alias("negative_n"),
        n(pos & F.col("source_quote")).alias("quote_d"), n(pos & hit & F.col("cq")).alias("quote_n"),
        n(pos & hit & F.col("cp")).alias("locator_n"), n(pos & some("claim_type")).alias("type_d"), n(pos & hit & (F.col("ct") == F.col("claim_type"))).alias("type_n"),
        n(pos & F.col("author_hedging")).alias("hedging_d"), n(pos & hit & F.col("author_hedging") & F.col("ch")).alias("hedging_n"),
        n(pos & F.col("scope_description")).alias("scope_d"), n(pos & hit & F.col("scope_description") & F.col("cs")).alias("scope_n"),
    )


def gate(counts: DataFrame, unsupported: DataFrame) -> DataFrame:
    """``metric, value, threshold, passed`` from :func:`metrics` and one row ``n`` of unsupported claims."""
    ratios = {"recall": ("recall_n", "positives"), "type_accuracy": ("type_n", "type_d"), "hedging_preservation": ("hedging_n", "hedging_d"), "scope_preservation": ("scope_n", "scope_d"), "quote_match": ("quote_n", "quote_d"), "locator_completeness": ("locator_n", "positives")}
    rows = [F.struct(F.lit(m).alias("metric"), percent(F.col(a), F.col(b)).cast("double").alias("value"), F.lit(float(THRESHOLDS[m])).alias("threshold"), F.lit(True).alias("least")) for m, (a, b) in ratios.items()]
    rows.append(F.struct(F.lit("negative_extraction").alias("metric"), percent(F.col("negative_n"), F.col("negatives")).cast("double").alias("value"), F.lit(0.0).alias("threshold"), F.lit(False).alias("least")))
    x = counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    u = unsupported.select(F.lit("unsupported_accepted").alias("metric"), F.col("n").cast("double").alias("value"), F.lit(0.0).alias("threshold"), F.lit(False).alias("least"))
    return x.unionByName(u).select("metric", "value", "threshold", F.when(F.col("least"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")).alias("passed"))
