"""Rules on records: allowed values, required fields, forbidden words, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The domains of the data model's enumerations.
CLAIM_TYPES = ("background_statement", "method_statement", "reported_observation", "reported_result", "author_interpretation", "author_conclusion", "author_hypothesis", "author_limitation", "future_work")
REVIEW_STATUSES = ("pending", "approved", "approved_with_edits", "rejected")
MATCH_STATUSES = ("exact", "normalised", "ambiguous", "not_found")
CONFIDENCES = ("high", "medium", "low")
RUN_STATUSES = ("started", "completed", "failed", "cancelled")
BATCH_STATUSES = ("exported", "partially_applied", "applied", "invalid")
#: The required fields of a claim, and words that no field may hold.
REQUIRED = ("claim_type", "source_quote", "faithful_paraphrase", "evidence_basis_description")
FORBIDDEN = ("internal_measurements", "internal_sample", "internal_db", "our_lab_id")


def empty(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) == ""


def schema_errors(required: tuple[str, ...] = REQUIRED) -> Column:
    """Messages on missing fields and on a claim type outside its domain; an empty array if there are none."""
    missing = [F.when(empty(f), F.lit(f"Missing required field: {f}")) for f in required]
    wrong = F.when(~empty("claim_type") & ~F.col("claim_type").isin(*CLAIM_TYPES), F.concat(F.lit("Invalid claim_type: "), F.col("claim_type")))
    return F.array_compact(F.array(*missing, wrong))


def leaks(fields: list[str], forbidden: tuple[str, ...] = FORBIDDEN) -> Column:
    """Messages on forbidden words in any of the fields, whatever their case."""
    return F.array_compact(F.array(*(F.when(F.contains(F.lower(F.col(f)), F.lit(w)), F.lit(f"Forbidden reference '{w}' in field '{f}'")) for f in fields for w in forbidden)))


def rule_counts(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """``table_name, rule, n_rows, n_violations``: all rules of a table in one pass; NULL conditions hold."""
    sums = df.agg(F.count("*").alias("n"), *(F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(rules.values())))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n_violations")) for i, name in enumerate(rules))))
    return sums.select(F.lit(table).alias("table_name"), F.col("n").alias("n_rows"), each.alias("x")).select("table_name", "x.rule", "n_rows", "x.n_violations")


def conflicts(df: DataFrame, key: list[str]) -> DataFrame:
    """``key, n_rows, n_contents, kind``: keys that come more than once, as 'identical' or 'conflict'.

    Contents are all other columns, NULL being a value.
    """
    rest = sorted(c for c in df.columns if c not in key)
    content = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rest)), 256)
    seen = df.groupBy(*key).agg(F.count("*").alias("n_rows"), F.count_distinct(content).alias("n_contents")).where("n_rows > 1")
    return seen.withColumn("kind", F.when(F.col("n_contents") > 1, "conflict").otherwise("identical"))
