"""Queries of aggregations, constraints and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import digests, validation
from claimloom.operators.deliveries import once
from claimloom.plans import sqltext as Q
from claimloom.plans.joins import IDS, _t, records
from claimloom.sources import sinks
from claimloom.sources.tables import table


def agg2_statuses(spark: SparkSession, d: str) -> DataFrame:
    """AGG-2, FLT-1, FLT-2: claims by review and match status."""
    return records(spark, d, "source_claims").groupBy("record_review_status", "quote_match_status").agg(F.count("*").alias("n"))


def agg3_max_page(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1, AGG-3, FLT-5: per source, the last page (0 where none is known), sections, and those with a heading."""
    s = records(spark, d, "source_sections")
    return s.groupBy("source_id").agg(F.coalesce(F.max("page_end"), F.lit(0)).alias("max_page"), F.count("*").alias("n_sections"), F.count_if(F.coalesce("heading", F.lit("")) != "").alias("n_headed"))


def agg5_tasks(spark: SparkSession, d: str) -> DataFrame:
    """AGG-5, STA-3 as roll-ups only: per task, its runs, whether all failed, its claims and whether any is pending."""
    r = records(spark, d, "processing_runs").where("task_id IS NOT NULL").groupBy("task_id").agg(F.count("*").alias("n_runs"), F.bool_and(F.col("status") == "failed").alias("all_failed"))
    c = records(spark, d, "source_claims").where("task_id IS NOT NULL").groupBy("task_id").agg(F.count("*").alias("n_claims"), F.bool_or(F.col("record_review_status") == "pending").alias("any_pending"))
    return r.join(c, "task_id", "full_outer").select("task_id", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("all_failed", F.lit(False)).alias("all_failed"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("any_pending", F.lit(False)).alias("any_pending"))


def agg6_batches(spark: SparkSession, d: str) -> DataFrame:
    """AGG-6, STA-4 as roll-ups only: rows and applied rows of each batch."""
    return records(spark, d, "review_batch_rows").groupBy("review_batch_id").agg(F.count("*").alias("n_rows"), F.count("applied_at").alias("n_applied"))


def agg12_tally(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12: review statuses of each claim type side by side."""
    return records(spark, d, "source_claims").groupBy("claim_type").pivot("record_review_status", list(validation.REVIEW_STATUSES)).agg(F.count(F.lit(1))).fillna(0)


def agg13_record_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, SRC-9: deliveries and records of every delivery log."""
    parts = [table(spark, d, t).agg(F.count("*").alias("n_rows"), F.count_distinct(i).alias("n_records")).select(F.lit(t).alias("table_name"), "n_rows", "n_records") for t, i in IDS.items()]
    return reduce(DataFrame.union, parts)


def agg14_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14, INT-2: claims delivered or kept more than once in the snapshots, with equal or different contents."""
    shots = table(spark, d, "claim_snapshots").drop("taken_at")
    return validation.conflicts(shots, ["snapshot_id", "claim_id"])


def win6_latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """WIN-6, STA-6: the run of each source that started last (of equal ones the greatest id)."""
    r = records(spark, d, "processing_runs").where("source_id IS NOT NULL")
    started = F.unix_micros(F.col("started_at").try_cast("timestamp"))
    return r.groupBy("source_id").agg(F.max_by(F.struct("run_id", "module_name", "status"), F.struct(started, F.col("run_id"))).alias("r")).select("source_id", "r.*")


def con1_rules(spark: SparkSession, d: str) -> DataFrame:
    """CON-1..3, INT-6: rows of each table against its rules, one pass a table."""
    v, no = validation, validation.empty
    outside = lambda c, values: F.col(c).isNotNull() & ~F.col(c).isin(*values)
    rules = {
        "source_claims": {"claim_type domain": outside("claim_type", v.CLAIM_TYPES), "record_review_status domain": outside("record_review_status", v.REVIEW_STATUSES), "quote_match_status domain": outside("quote_match_status", v.MATCH_STATUSES), "source_quote present": no("source_quote"), "created_by_run_id present": no("created_by_run_id"), "origin_scope fixed": F.col("origin_scope") != "external"},
        "claim_locators": {"locator_confidence domain": outside("locator_confidence", v.CONFIDENCES), "offsets in order": F.col("character_end") < F.col("character_start"), "page positive": F.col("page") < 1},
        "source_sections": {"pages in order": F.col("page_end") < F.col("page_start"), "text present": no("text"), "hash of text": F.col("text_sha256") != F.sha2("text", 256)},
        "processing_runs": {"status domain": outside("status", v.RUN_STATUSES), "error with failure": (F.col("status") == "failed") & F.col("error_type").isNull()},
        "review_batches": {"status domain": outside("status", v.BATCH_STATUSES)},
        "documents": {"n_chars right": F.col("n_chars") != F.length("text"), "source_id present": no("source_id")},
    }
    return reduce(DataFrame.union, [v.rule_counts(table(spark, d, t), t, r) for t, r in rules.items()])


def con1_unique(spark: SparkSession, d: str) -> DataFrame:
    """CON-1: batch rows that share a batch and place, or a batch and claim."""
    rows = records(spark, d, "review_batch_rows")
    parts = [rows.groupBy("review_batch_id", k).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(k).alias("key"), "n_keys", "n_rows") for k in ("row_sequence", "claim_id")]
    return parts[0].union(parts[1])


def hsh2_input_hash(spark: SparkSession, d: str) -> DataFrame:
    """HSH-1, HSH-2: content hashes, and short hashes of joined components."""
    return records(spark, d, "extraction_requests").select("request_id", F.sha2("section_text", 256).alias("text_sha256"), digests.short_hash(F.col("source_id"), F.col("section_heading"), F.col("task_description")).alias("input_hash"))


def hsh3_row_hash(spark: SparkSession, d: str) -> DataFrame:
    """HSH-3: hashes of canonical rows."""
    return records(spark, d, "source_claims").select("claim_id", digests.row_hash(["claim_id", "claim_type", "source_quote", "faithful_paraphrase", "evidence_basis_description", "author_hedging"]).alias("row_hash"))


def hsh4_packet_digest(spark: SparkSession, d: str) -> DataFrame:
    """HSH-4, AGG-10, STA-5: a digest of each batch's rows with their places; batches of any size."""
    rows = records(spark, d, "review_batch_rows").select("review_batch_id", digests.row_hash(["row_sequence", "claim_id", "row_input_sha256"]).alias("h"))
    return rows.groupBy("review_batch_id").agg(*digests.multiset_digest(F.col("h")))


def int5_compare(spark: SparkSession, d: str) -> DataFrame:
    """INT-5, JOIN-17: what differs between the claims and their latest snapshot, by kind."""
    cols = ["source_id", "claim_type", "record_review_status", "quote_match_status", "author_hedging"]
    shots = table(spark, d, "claim_snapshots")
    last = shots.select("snapshot_id", "taken_at").distinct().orderBy(F.desc("taken_at"), F.desc("snapshot_id")).limit(1)
    latest = shots.join(last.select("snapshot_id"), "snapshot_id").groupBy("claim_id").agg(F.max_by(F.struct(*cols), F.struct(F.unix_micros(F.col("updated_at").try_cast("timestamp")), digests.row_hash(cols))).alias("r")).select("claim_id", "r.*")
    return digests.differences(latest, records(spark, d, "source_claims"), ["claim_id"], cols).groupBy("change").agg(F.count("*").alias("n_claims"))


def snk3_markdown(spark: SparkSession, d: str) -> DataFrame:
    """SNK-3, SNK-7: each page of a source as Markdown under its marker, and each claim as a list item."""
    pages = records(spark, d, "source_sections").select(F.col("section_id").alias("record_id"), F.concat(sinks.page_marker(F.col("page_start")), F.lit("\n"), F.col("text")).alias("markdown")).where("markdown IS NOT NULL")
    items = records(spark, d, "source_claims").select(F.col("claim_id").alias("record_id"), sinks.markdown_row(["claim_type", "source_quote", "author_hedging"]).alias("markdown"))
    return pages.union(items).select("record_id", F.sha2("markdown", 256).alias("markdown_sha256"))


QUERIES = {f.__name__: f for f in (agg2_statuses, agg3_max_page, agg5_tasks, agg6_batches, agg12_tally, agg13_record_counts, agg14_conflicts, win6_latest_runs, con1_rules, con1_unique, hsh2_input_hash, hsh3_row_hash, hsh4_packet_digest, int5_compare, snk3_markdown)}

def _rules() -> str:
    v = validation
    inside = lambda c, values: f"{c} NOT IN ({', '.join(map(repr, values))})"
    no = lambda c: f"coalesce({c}, '') = ''"
    rules = [
        ("source_claims", {"claim_type domain": inside("claim_type", v.CLAIM_TYPES), "record_review_status domain": inside("record_review_status", v.REVIEW_STATUSES), "quote_match_status domain": inside("quote_match_status", v.MATCH_STATUSES), "source_quote present": no("source_quote"), "created_by_run_id present": no("created_by_run_id"), "origin_scope fixed": "origin_scope <> 'external'"}),
        ("claim_locators", {"locator_confidence domain": inside("locator_confidence", v.CONFIDENCES), "offsets in order": "character_end < character_start", "page positive": "page < 1"}),
        ("source_sections", {"pages in order": "page_end < page_start", "text present": no("text"), "hash of text": "text_sha256 <> sha256(text)"}),
        ("processing_runs", {"status domain": inside("status", v.RUN_STATUSES), "error with failure": "status = 'failed' AND error_type IS NULL"}),
        ("review_batches", {"status domain": inside("status", v.BATCH_STATUSES)}),
        ("documents", {"n_chars right": "n_chars <> length(text)", "source_id present": no("source_id")}),
    ]
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{name}' AS rule, count(*) AS n_rows, count(*) FILTER (WHERE {bad}) AS n_violations FROM {t}" for t, rs in rules for name, bad in rs.items())


_CHANGED = ["source_id", "claim_type", "record_review_status", "quote_match_status", "author_hedging"]

SQL = {
    "agg2_statuses": f"SELECT record_review_status, quote_match_status, count(*) AS n FROM {_t('source_claims')} GROUP BY ALL",
    "agg3_max_page": f"SELECT source_id, coalesce(max(page_end), 0) AS max_page, count(*) AS n_sections, count(*) FILTER (WHERE heading <> '') AS n_headed FROM {_t('source_sections')} GROUP BY 1",
    "agg5_tasks": f"""WITH r AS (SELECT task_id, count(*) AS n_runs, bool_and(status = 'failed') AS all_failed FROM {_t('processing_runs')} WHERE task_id IS NOT NULL GROUP BY 1), c AS (SELECT task_id, count(*) AS n_claims, bool_or(record_review_status = 'pending') AS any_pending FROM {_t('source_claims')} WHERE task_id IS NOT NULL GROUP BY 1)
        SELECT task_id, coalesce(n_runs, 0) AS n_runs, coalesce(all_failed, false) AS all_failed, coalesce(n_claims, 0) AS n_claims, coalesce(any_pending, false) AS any_pending FROM r FULL JOIN c USING (task_id)""",
    "agg6_batches": f"SELECT review_batch_id, count(*) AS n_rows, count(applied_at) AS n_applied FROM {_t('review_batch_rows')} GROUP BY 1",
    "agg12_tally": f"SELECT claim_type, {', '.join(f'count(*) FILTER (WHERE record_review_status = {s!r}) AS {s}' for s in validation.REVIEW_STATUSES)} FROM {_t('source_claims')} GROUP BY 1",
    "agg13_record_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT {i}) AS n_records FROM {t}" for t, i in IDS.items()),
    "agg14_conflicts": f"SELECT snapshot_id, claim_id, count(*) AS n_rows, count(DISTINCT {Q.canonical_row(['author_hedging', 'claim_type', 'quote_match_status', 'record_review_status', 'source_id', 'updated_at'])}) AS n_contents, CASE WHEN n_contents > 1 THEN 'conflict' ELSE 'identical' END AS kind FROM claim_snapshots GROUP BY ALL HAVING count(*) > 1",
    "win6_latest_runs": f"SELECT source_id, run_id, module_name, status FROM {_t('processing_runs')} WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY CAST(started_at AS TIMESTAMPTZ) DESC NULLS LAST, run_id DESC) = 1",
    "con1_rules": _rules(),
    "con1_unique": " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS n_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM {_t('review_batch_rows')} GROUP BY review_batch_id, {k} HAVING count(*) > 1)" for k in ("row_sequence", "claim_id")),
    "hsh2_input_hash": f"SELECT request_id, sha256(section_text) AS text_sha256, left(sha256(concat_ws('|', source_id, section_heading, task_description)), 16) AS input_hash FROM {_t('extraction_requests')}",
    "hsh3_row_hash": f"SELECT claim_id, sha256({Q.canonical_row(['claim_id', 'claim_type', 'source_quote', 'faithful_paraphrase', 'evidence_basis_description', 'author_hedging'])}) AS row_hash FROM {_t('source_claims')}",
    "hsh4_packet_digest": f"SELECT review_batch_id, count(*) AS n_rows, {Q.lane('h', 1)} AS digest_a, {Q.lane('h', 16)} AS digest_b FROM (SELECT review_batch_id, sha256({Q.canonical_row(['row_sequence', 'claim_id', 'row_input_sha256'])}) AS h FROM {_t('review_batch_rows')}) GROUP BY 1",
    "int5_compare": f"""WITH l AS (SELECT * FROM claim_snapshots WHERE snapshot_id = (SELECT snapshot_id FROM claim_snapshots ORDER BY taken_at DESC, snapshot_id DESC LIMIT 1) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC NULLS LAST, sha256({Q.canonical_row(_CHANGED)}) DESC) = 1),
        j AS (SELECT CASE WHEN l.claim_id IS NULL THEN 'added' WHEN c.claim_id IS NULL THEN 'removed' WHEN ({', '.join('l.' + x for x in _CHANGED)}) IS DISTINCT FROM ({', '.join('c.' + x for x in _CHANGED)}) THEN 'changed' END AS change FROM l FULL JOIN {_t('source_claims')} c ON c.claim_id = l.claim_id)
        SELECT change, count(*) AS n_claims FROM j WHERE change IS NOT NULL GROUP BY 1""",
    "snk3_markdown": f"""SELECT section_id AS record_id, sha256(chr(10) || '<!-- PAGE ' || page_start || ' -->' || chr(10) || chr(10) || text) AS markdown_sha256 FROM {_t('source_sections')} WHERE page_start IS NOT NULL AND text IS NOT NULL
        UNION ALL SELECT claim_id, sha256({" || ".join(f"'{p}{c}: ' || regexp_replace(coalesce({c}, ''), '[\\r\\n]+', ' ', 'g') || chr(10)" for p, c in (('- ', 'claim_type'), ('  ', 'source_quote'), ('  ', 'author_hedging')))}) FROM {_t('source_claims')}""",
}
