"""Queries of joins, set operations, sorts and top-k over the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import deliveries, orphans, ranges
from claimloom.operators.deliveries import once
from claimloom.plans import sqltext as Q
from claimloom.sources.tables import table

#: Every reference between the tables, without regard to deletions.
ALL_REFERENCES = (
    *orphans.REFERENCES,
    orphans.Reference("claim_locators", "locator_id", "section_id", "source_sections", "section_id"),
    orphans.Reference("source_sections", "section_id", "source_id", "sources", "source_id"),
    orphans.Reference("processing_runs", "run_id", "source_id", "sources", "source_id"),
    orphans.Reference("review_batches", "review_batch_id", "run_id", "processing_runs", "run_id"),
    orphans.Reference("review_batches", "review_batch_id", "source_id", "sources", "source_id"),
    orphans.Reference("review_batch_rows", "review_row_id", "claim_id", "source_claims", "claim_id"),
    orphans.Reference("claim_revisions", "revision_id", "claim_id", "source_claims", "claim_id"),
    orphans.Reference("extraction_requests", "request_id", "section_id", "source_sections", "section_id"),
)
IDS = {"source_claims": "claim_id", "source_sections": "section_id", "claim_locators": "locator_id", "processing_runs": "run_id", "sources": "source_id", "review_batches": "review_batch_id", "review_batch_rows": "review_row_id", "claim_revisions": "revision_id", "extraction_requests": "request_id", "raw_claim_records": "raw_id"}


def records(spark: SparkSession, d: str, name: str) -> DataFrame:
    return once(table(spark, d, name), IDS[name])


def join1_runs_claims(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-1: claims per module, mode and status of the run that made them."""
    claims = records(spark, d, "source_claims").groupBy(F.col("created_by_run_id").alias("run_id")).agg(F.count("*").alias("n"))
    runs = records(spark, d, "processing_runs").select("run_id", "module_name", "status")
    return runs.join(claims, "run_id").groupBy("module_name", "status").agg(F.sum("n").alias("n_claims"))


def join2_claim_locators(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-2, SRT-3: claims with their locators, if any."""
    c = records(spark, d, "source_claims").select("claim_id", "claim_type")
    at = records(spark, d, "claim_locators").select("claim_id", "locator_id", F.col("page").cast("string").alias("page"), "locator_confidence")
    return c.join(at, "claim_id", "left").orderBy(F.col("page").asc_nulls_first(), "claim_type", "claim_id", "locator_id")


def join3_review_star(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-3, JOIN-4, JOIN-5, PRJ-1, PRJ-3, SRT-2: claims with locator, source, section by page, and run.

    Sources and runs are reduced to what is needed before they are joined; a source with a third of the
    claims is left to the splitting of skewed joins.
    """
    c = records(spark, d, "source_claims").select("claim_id", "source_id", "claim_type", "created_by_run_id")
    at = records(spark, d, "claim_locators").select("claim_id", "locator_id", "page")
    src = records(spark, d, "sources").select("source_id", F.col("title").alias("source_title"))
    sec = records(spark, d, "source_sections").select("source_id", F.col("page_start").alias("page"), "section_id", "heading")
    run = records(spark, d, "processing_runs").select(F.col("run_id").alias("created_by_run_id"), "model_name")
    rows = c.join(at, "claim_id", "left").join(src, "source_id", "left").join(sec, ["source_id", "page"], "left").join(run, "created_by_run_id", "left")
    return rows.select("claim_id", "locator_id", "section_id", F.coalesce("page", F.lit(2147483647)).alias("page"), "claim_type", "source_title", "heading", "model_name")


def join5_page_range(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-5 by range: locators with the sections of their claim's source that cover the page.

    Sections without both ends cover no page; ranges may be of any length.
    """
    c = records(spark, d, "source_claims").select("claim_id", "source_id")
    at = records(spark, d, "claim_locators").select("locator_id", "claim_id", "page").join(c, "claim_id")
    sec = records(spark, d, "source_sections").select("source_id", "section_id", "page_start", "page_end")
    return ranges.in_ranges(at, sec, ["source_id"], "page", "page_start", "page_end").select("locator_id", "section_id", "page")


def join6_trace(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-6: per source, its claims, sections, and claims whose located section is of the same source.

    Both sides are counted per source before the join, in place of pairing every claim with every section.
    """
    c = records(spark, d, "source_claims").select("claim_id", "source_id")
    s = records(spark, d, "source_sections").select("section_id", "source_id")
    traced = records(spark, d, "claim_locators").select("claim_id", "section_id").join(c, "claim_id").join(s.withColumnRenamed("source_id", "of"), "section_id").where("of = source_id").groupBy("source_id").agg(F.count_distinct("claim_id").alias("n_traced"))
    rows = c.groupBy("source_id").agg(F.count("*").alias("n_claims")).join(s.groupBy("source_id").agg(F.count("*").alias("n_sections")), "source_id", "left").join(traced, "source_id", "left")
    return rows.select("source_id", "n_claims", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.coalesce("n_traced", F.lit(0)).alias("n_traced"))


def join7_scope_rows(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-7: review rows by the source of their batch's run, over three tables."""
    n = records(spark, d, "review_batch_rows").groupBy("review_batch_id").agg(F.count("*").alias("n"))
    b = records(spark, d, "review_batches").select("review_batch_id", "run_id")
    r = records(spark, d, "processing_runs").select("run_id", "source_id")
    return n.join(b, "review_batch_id").join(r, "run_id").groupBy("source_id").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_batches"))


def join8_scope_revisions(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-8: revisions scoped to sources through their claims, repeats kept."""
    n = records(spark, d, "claim_revisions").groupBy("claim_id").agg(F.count("*").alias("n"))
    return n.join(records(spark, d, "source_claims").select("claim_id", "source_id"), "claim_id").groupBy("source_id").agg(F.sum("n").alias("n_revisions"))


def join9_batch_sources(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-9, AGG-4: the distinct sources and tasks that each batch touches."""
    b = records(spark, d, "review_batches").select("review_batch_id", "run_id", "source_id")
    r = records(spark, d, "processing_runs").select("run_id", "task_id")
    return b.join(r, "run_id").select("review_batch_id", "source_id", "task_id").distinct()


def join10_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-10: claims that the latest snapshot lacks, each once."""
    shots = table(spark, d, "claim_snapshots")
    last = shots.select("snapshot_id", "taken_at").distinct().orderBy(F.desc("taken_at"), F.desc("snapshot_id")).limit(1)
    present = shots.join(last.select("snapshot_id"), "snapshot_id")
    return deliveries.new_only(table(spark, d, "source_claims").select("claim_id", "source_id", "received_at"), present, "claim_id").select("claim_id", "source_id")


def join11_ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-11: documents by content; the least id stands for equal ones."""
    return deliveries.by_content(table(spark, d, "documents"), "doc_id", "text")


def join12_violations(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-12, SET-5: dead references of all rules, counted."""
    names = sorted({n for r in ALL_REFERENCES for n in (r.table, r.parent)})
    found = orphans.orphans({n: table(spark, d, n) for n in names}, table(spark, d, "deletion_log").limit(0), ALL_REFERENCES)
    return found.groupBy("table_name", "field_name").agg(F.count_distinct("record_id").alias("n_records"))


def join13_batch_context(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-13: review rows whose batch, claim or source disagree, by problem."""
    rows = records(spark, d, "review_batch_rows").select("review_row_id", "review_batch_id", "claim_id")
    b = records(spark, d, "review_batches").select("review_batch_id", F.col("source_id").alias("bs"))
    c = records(spark, d, "source_claims").select("claim_id", F.col("source_id").alias("cs"))
    x = rows.join(b, "review_batch_id", "left").join(c, "claim_id", "left")
    problem = F.when(F.col("bs").isNull(), "batch unknown").when(F.col("cs").isNull(), "claim unknown").when(F.col("bs") != F.col("cs"), "sources differ").otherwise("agrees")
    return x.groupBy(problem.alias("problem")).agg(F.count("*").alias("n_rows"))


def join16_labels(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-16: locators' figure and table labels, and whether any section of their claim's source names them."""
    c = records(spark, d, "source_claims").select("claim_id", "source_id")
    at = records(spark, d, "claim_locators").select("locator_id", "claim_id", F.explode(F.array_compact(F.array("figure_label", "table_label"))).alias("label"))
    rows = at.join(c, "claim_id", "left").withColumn("l", F.lower("label"))
    s = records(spark, d, "source_sections").select("source_id", F.lower("text").alias("t"))
    hits = rows.select("source_id", "l").distinct().join(s, "source_id").groupBy("source_id", "l").agg(F.bool_or(F.contains("t", F.col("l"))).alias("named"))
    return rows.join(hits, ["source_id", "l"], "left").select("locator_id", "label", F.coalesce("named", F.lit(False)).alias("named"))


def set1_tasks(spark: SparkSession, d: str) -> DataFrame:
    """SET-1: tasks of a source through its claims or its runs."""
    parts = [records(spark, d, t).where("task_id IS NOT NULL").select("source_id", "task_id") for t in ("source_claims", "processing_runs")]
    return parts[0].union(parts[1]).distinct()


def set2_reviewed(spark: SparkSession, d: str) -> DataFrame:
    """SET-2: claims touched by a review, through rows or revisions."""
    return records(spark, d, "review_batch_rows").select("claim_id").union(records(spark, d, "claim_revisions").select("claim_id")).distinct()


def set3_differences(spark: SparkSession, d: str) -> DataFrame:
    """SET-3: sources with sections only, with claims only, with both."""
    s, c = (table(spark, d, t).where("source_id IS NOT NULL").select("source_id").distinct() for t in ("source_sections", "source_claims"))
    parts = [x.withColumn("side", F.lit(n)) for x, n in ((s.subtract(c), "sections"), (c.subtract(s), "claims"), (s.intersect(c), "both"))]
    return reduce(DataFrame.union, parts)


def set4_layouts(spark: SparkSession, d: str) -> DataFrame:
    """SET-4, SRC-11, PRJ-4: texts of two layouts under one schema."""
    s = records(spark, d, "source_sections").select(F.col("section_id").alias("record_id"), "section_type", "heading", F.length("text").alias("n_chars"), "parser_name")
    r = records(spark, d, "extraction_requests").select(F.col("request_id").alias("record_id"), "section_type", F.col("section_heading").alias("heading"), F.length("section_text").alias("n_chars"))
    return s.unionByName(r, allowMissingColumns=True)


def srt1_latest_claims(spark: SparkSession, d: str) -> DataFrame:
    """SRT-1, FLT-4, STA-7: the 20 claims created last."""
    c = records(spark, d, "source_claims").select("claim_id", F.unix_micros(F.col("created_at").try_cast("timestamp")).alias("created_us"))
    return c.orderBy(F.desc("created_us"), "claim_id").limit(20)


def srt5_largest_sources(spark: SparkSession, d: str) -> DataFrame:
    """SRT-5, SRT-6: the ten sources with the most claims, ties by id."""
    return records(spark, d, "source_claims").groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").limit(10)


QUERIES = {f.__name__: f for f in (join1_runs_claims, join2_claim_locators, join3_review_star, join5_page_range, join6_trace, join7_scope_rows, join8_scope_revisions, join9_batch_sources, join10_first_wins, join11_ingest_dedup, join12_violations, join13_batch_context, join16_labels, set1_tasks, set2_reviewed, set3_differences, set4_layouts, srt1_latest_claims, srt5_largest_sources)}


def _t(name: str) -> str:
    return Q.once(name, IDS[name])


def _key(x: str) -> str:
    return f"nullif(lower({Q.strip(x)}), '')"


SQL = {
    "join1_runs_claims": f"SELECT module_name, r.status, count(*) AS n_claims FROM {_t('processing_runs')} r JOIN {_t('source_claims')} c ON c.created_by_run_id = r.run_id GROUP BY ALL",
    "join2_claim_locators": f"SELECT c.claim_id, c.claim_type, l.locator_id, CAST(l.page AS VARCHAR) AS page, l.locator_confidence FROM {_t('source_claims')} c LEFT JOIN {_t('claim_locators')} l USING (claim_id)",
    "join3_review_star": f"""SELECT c.claim_id, l.locator_id, ss.section_id, coalesce(l.page, 2147483647) AS page, c.claim_type, s.title AS source_title, ss.heading, r.model_name
        FROM {_t('source_claims')} c LEFT JOIN {_t('claim_locators')} l ON l.claim_id = c.claim_id LEFT JOIN {_t('sources')} s ON s.source_id = c.source_id
        LEFT JOIN {_t('source_sections')} ss ON ss.source_id = c.source_id AND ss.page_start = l.page LEFT JOIN {_t('processing_runs')} r ON r.run_id = c.created_by_run_id""",
    "join5_page_range": f"SELECT l.locator_id, s.section_id, l.page FROM {_t('claim_locators')} l JOIN {_t('source_claims')} c USING (claim_id) JOIN {_t('source_sections')} s ON s.source_id = c.source_id AND l.page BETWEEN s.page_start AND s.page_end",
    "join6_trace": f"""SELECT source_id, count(*) AS n_claims, (SELECT count(*) FROM {_t('source_sections')} s WHERE s.source_id = c.source_id) AS n_sections,
        (SELECT count(DISTINCT x.claim_id) FROM {_t('claim_locators')} l JOIN {_t('source_claims')} x USING (claim_id) JOIN {_t('source_sections')} s USING (section_id) WHERE s.source_id = x.source_id AND x.source_id = c.source_id) AS n_traced FROM {_t('source_claims')} c GROUP BY source_id""",
    "join7_scope_rows": f"SELECT source_id, count(*) AS n_rows, count(DISTINCT review_batch_id) AS n_batches FROM (SELECT w.review_batch_id, r.source_id FROM {_t('review_batch_rows')} w JOIN {_t('review_batches')} b USING (review_batch_id) JOIN {_t('processing_runs')} r ON r.run_id = b.run_id) GROUP BY source_id",
    "join8_scope_revisions": f"SELECT c.source_id, count(*) AS n_revisions FROM {_t('claim_revisions')} v JOIN {_t('source_claims')} c USING (claim_id) GROUP BY 1",
    "join9_batch_sources": f"SELECT DISTINCT b.review_batch_id, b.source_id, r.task_id FROM {_t('review_batches')} b JOIN {_t('processing_runs')} r USING (run_id)",
    "join10_first_wins": "SELECT DISTINCT claim_id, source_id FROM source_claims WHERE claim_id NOT IN (SELECT claim_id FROM claim_snapshots WHERE snapshot_id = (SELECT snapshot_id FROM claim_snapshots ORDER BY taken_at DESC, snapshot_id DESC LIMIT 1))",
    "join11_ingest_dedup": "SELECT doc_id AS record_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS is_new FROM documents",
    "join12_violations": " UNION ALL ".join(f"SELECT '{r.table}' AS table_name, '{r.field}' AS field_name, count(DISTINCT {r.record_id}) AS n_records FROM {r.table} WHERE {_key(r.field)} NOT IN (SELECT {_key(r.parent_key)} FROM {r.parent} WHERE {r.parent_key} IS NOT NULL) HAVING count(*) > 0" for r in ALL_REFERENCES),
    "join13_batch_context": f"""SELECT CASE WHEN b.source_id IS NULL THEN 'batch unknown' WHEN c.source_id IS NULL THEN 'claim unknown' WHEN b.source_id <> c.source_id THEN 'sources differ' ELSE 'agrees' END AS problem, count(*) AS n_rows
        FROM {_t('review_batch_rows')} w LEFT JOIN {_t('review_batches')} b ON b.review_batch_id = w.review_batch_id LEFT JOIN {_t('source_claims')} c ON c.claim_id = w.claim_id GROUP BY 1""",
    "join16_labels": f"""SELECT locator_id, label, EXISTS (SELECT 1 FROM {_t('source_sections')} s WHERE s.source_id = x.source_id AND contains(lower(s.text), lower(x.label))) AS named
        FROM (SELECT locator_id, source_id, unnest([figure_label, table_label]) AS label FROM {_t('claim_locators')} LEFT JOIN (SELECT claim_id, source_id FROM {_t('source_claims')}) USING (claim_id)) x WHERE label IS NOT NULL""",
    "set1_tasks": "SELECT source_id, task_id FROM source_claims WHERE task_id IS NOT NULL UNION SELECT source_id, task_id FROM processing_runs WHERE task_id IS NOT NULL",
    "set2_reviewed": "SELECT claim_id FROM review_batch_rows UNION SELECT claim_id FROM claim_revisions",
    "set3_differences": "WITH s AS (SELECT DISTINCT source_id FROM source_sections WHERE source_id IS NOT NULL), c AS (SELECT DISTINCT source_id FROM source_claims WHERE source_id IS NOT NULL) SELECT source_id, CASE WHEN s.source_id IS NULL THEN 'claims' WHEN c.source_id IS NULL THEN 'sections' ELSE 'both' END AS side FROM s FULL JOIN c USING (source_id)",
    "set4_layouts": f"SELECT section_id AS record_id, section_type, heading, length(text) AS n_chars, parser_name FROM {_t('source_sections')} UNION ALL SELECT request_id, section_type, section_heading, length(section_text), NULL FROM {_t('extraction_requests')}",
    "srt1_latest_claims": f"SELECT claim_id, epoch_us(CAST(created_at AS TIMESTAMPTZ)) AS created_us FROM {_t('source_claims')} ORDER BY created_us DESC, claim_id LIMIT 20",
    "srt5_largest_sources": f"SELECT source_id, count(*) AS n FROM {_t('source_claims')} GROUP BY 1 ORDER BY n DESC, source_id LIMIT 10",
}
