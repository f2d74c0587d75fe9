"""Queries of changes applied to tables, snapshots, checks, and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.durable import written
from claimloom.functions.text import instant_us
from claimloom.operators import history, merging, orphans, providers, quotes, search, validation
from claimloom.plans import sqltext as Q
from claimloom.plans.joins import _t, records
from claimloom.plans.problems import SQL as PROBLEMS
from claimloom.plans.search import FIELDS
from claimloom.sources.tables import table

_READ = ", ".join(f"{f} STRING" for f in history.FIELDS)


def _last_contents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "claim_revisions").select("revision_id", "claim_id", instant_us("created_at").alias("us"), F.from_json("new_content_json", _READ).alias("n"))
    return merging.latest_change(rows.where("us IS NOT NULL").select("revision_id", "claim_id", "us", *(F.col(f"n.{f}").alias(f) for f in history.FIELDS)), "claim_id", "revision_id", ["us"], list(history.FIELDS))


def sta1_apply_revisions(spark: SparkSession, d: str) -> DataFrame:
    """STA-1, STA-10, STA-11, SNK-10: claims after all revisions, each applied once, the last one holding."""
    base = records(spark, d, "source_claims").select("claim_id", *history.FIELDS)
    return merging.upsert(base, _last_contents(spark, d), "claim_id", list(history.FIELDS))


def sta2_edited_quotes(spark: SparkSession, d: str) -> DataFrame:
    """STA-2: each edited claim checked: its source has text, its quote stands there, its type is known, and its first locator's page and section are the source's."""
    c = records(spark, d, "source_claims").select("claim_id", "source_id")
    s = quotes.readied(records(spark, d, "source_sections").select("section_id", "source_id", "sequence_number", "page_end", "text"))
    at = records(spark, d, "claim_locators").groupBy("claim_id").agg(F.min_by(F.struct("page", "section_id"), "locator_id").alias("l")).select("claim_id", "l.*")
    edits = quotes.asking(written(_last_contents(spark, d), "edits").join(c, "claim_id"))
    of_source = s.groupBy("source_id").agg(F.coalesce(F.max("page_end"), F.lit(0)).alias("last_page"), F.max(F.length("text") > 0).alias("has_text"))
    found = quotes.in_source(edits, s).select("claim_id", "status")
    types = _last_contents(spark, d).select("claim_id", "claim_type")
    rows = edits.join(types, "claim_id").join(found, "claim_id", "left").join(of_source, "source_id", "left").join(at, "claim_id", "left").join(s.select("section_id", F.col("source_id").alias("of")), "section_id", "left")
    wrong = [
        F.when(F.col("nq").isNull() | (F.col("nq") == ""), "empty quote").when(F.col("status").isNull(), "quote not found"),
        F.when(F.col("page") < 1, "page invalid").when(F.col("page") > F.col("last_page"), "page beyond the last"),
        F.when(F.col("section_id").isNotNull() & ~F.col("of").eqNullSafe(F.col("source_id")), "section not of the source"),
        F.when((F.col("claim_type") != "") & ~F.col("claim_type").isin(*validation.CLAIM_TYPES), "type unknown"),
    ]
    errors = F.when(F.coalesce("has_text", F.lit(False)), F.array_join(F.array_compact(F.array(*wrong)), "; ")).otherwise("no text")
    return rows.select("claim_id", F.coalesce("status", F.lit("not_found")).alias("status"), errors.alias("errors"))


def sta8_persisted(spark: SparkSession, d: str) -> DataFrame:
    """STA-8, FLT-8, PRJ-5, WIN-7: matched claims with the confidence and page that their locator gets."""
    c = records(spark, d, "source_claims").where("quote_match_status IN ('exact', 'normalised')")
    at = records(spark, d, "claim_locators").groupBy("claim_id").agg(F.min_by(F.struct("page", "section_id"), "locator_id").alias("l")).select("claim_id", "l.page", "l.section_id")
    s = records(spark, d, "source_sections").select("section_id", "page_start")
    rows = c.select("claim_id", "quote_match_status").join(at, "claim_id", "left").join(s, "section_id", "left")
    return rows.select("claim_id", F.when(F.col("quote_match_status") == "exact", "high").otherwise("medium").alias("confidence"), F.coalesce(F.nullif("page", F.lit(0)), "page_start", F.lit(-1)).alias("page"))


def sta9_first_sections(spark: SparkSession, d: str) -> DataFrame:
    """STA-9: the section first received for each place of a source; later ones are ignored."""
    s = table(spark, d, "source_sections").where("source_id IS NOT NULL AND sequence_number IS NOT NULL")
    return merging.first_per(s, ["source_id", "sequence_number"], ["received_at", "section_id"], ["section_id", "text_sha256"])


def int8_checks(spark: SparkSession, d: str) -> DataFrame:
    """INT-8, EVL-5, AGG-1: named checks with what they counted; the review workflow is a business rule and left out."""
    approved = F.col("record_review_status").isin("approved", "approved_with_edits")
    terms = F.size(search.tokens(F.concat_ws("\n", *FIELDS)))
    other = lambda c, v: ~F.col(c).eqNullSafe(v)
    c = records(spark, d, "source_claims").agg(
        F.count_if(F.coalesce("source_quote", F.lit("")) == "").alias("no_quote"), F.count_if(other("origin_scope", "external")).alias("not_external"), F.count_if(other("scientific_verification_status", "unverified")).alias("not_unverified"),
        F.count_if(approved).alias("approved"), F.count_if(approved & (terms > 0)).alias("indexed"),
    )
    at = records(spark, d, "claim_locators").agg(F.count_if(F.col("page").isNull()).alias("no_page"), F.count_distinct(F.when(F.col("page").isNotNull(), F.col("claim_id"))).alias("traced"))
    s = records(spark, d, "sources")
    of_sources = s.agg(F.count_if(other("origin_scope", "external")).alias("not_external"))
    repeated = s.where("original_file_sha256 IS NOT NULL").groupBy("original_file_sha256").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    first = {n: table(spark, d, n) for n in sorted({n for r in orphans.REFERENCES for n in (r.table, r.parent)})}
    dead = orphans.orphans(first, table(spark, d, "deletion_log")).agg(F.count_distinct("table_name", "field_name", "record_id").alias("dead"))
    row = lambda name, counted, ok: F.struct(F.lit(name).alias("check_name"), F.col(counted).alias("counted"), ok.alias("passed"))
    none = lambda name, counted: row(name, counted, F.col(counted) == 0)
    parts = [
        (c, [none("quotes present", "no_quote"), none("origin isolated", "not_external"), none("claims unverified", "not_unverified"), row("approved claims indexed", "indexed", F.col("indexed") == F.col("approved"))]),
        (at, [none("locators with page", "no_page"), row("quotes traced", "traced", F.col("traced") > 0)]), (of_sources, [none("sources external", "not_external")]), (repeated, [none("files taken in once", "repeated")]), (dead, [none("references live", "dead")]),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.explode(F.array(*rows)).alias("x")) for df, rows in parts]).select("x.*")


def txt7_prompts(spark: SparkSession, d: str) -> DataFrame:
    """TXT-7: the prompt of each request, shown by length and hash."""
    made = providers.prompt("Task: {task}\nHeading: {heading}\n\n{text}", task=F.col("task_description"), heading=F.col("section_heading"), text=F.col("section_text"))
    return records(spark, d, "extraction_requests").select("request_id", F.length(made).alias("n_chars"), F.sha2(made, 256).alias("prompt_sha256"))


def fts3_index_update(spark: SparkSession, d: str) -> DataFrame:
    """FTS-3: the index after the revised claims were indexed anew, by term."""
    base = records(spark, d, "source_claims").select("claim_id", *FIELDS)
    revised = merging.upsert(base, _last_contents(spark, d), "claim_id", FIELDS).join(_last_contents(spark, d).select("claim_id"), "claim_id", "left_semi")
    posts = search.reindexed(search.postings(search.indexed(base, "claim_id", FIELDS)), search.indexed(revised, "claim_id", FIELDS))
    return search.term_stats(posts)


QUERIES = {f.__name__: f for f in (sta1_apply_revisions, sta2_edited_quotes, sta8_persisted, sta9_first_sections, int8_checks, txt7_prompts, fts3_index_update)}

_NEW = ", ".join(f"json_extract_string(new_content_json, '$.{f}') AS {f}" for f in history.FIELDS)
_LAST = f"(SELECT claim_id, {_NEW} FROM (SELECT * FROM claim_revisions QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY CAST(created_at AS TIMESTAMPTZ) DESC, revision_id DESC) = 1))"
_AFTER = f"(SELECT c.claim_id, {', '.join(f'CASE WHEN l.claim_id IS NULL THEN c.{f} ELSE l.{f} END AS {f}' for f in history.FIELDS)} FROM {_t('source_claims')} c LEFT JOIN {_LAST} l USING (claim_id))"
_TOKENS = "regexp_extract_all(lower(strip_accents(concat_ws(chr(10), source_quote, faithful_paraphrase, evidence_basis_description))), '[\\p{L}\\p{N}]+')"

SQL = {
    "sta1_apply_revisions": f"SELECT * FROM {_AFTER}",
    "sta2_edited_quotes": f"""WITH e AS (SELECT l.claim_id, l.source_quote AS q, l.claim_type, {Q.normalise('l.source_quote')} AS nq, c.source_id FROM {_LAST} l JOIN {_t('source_claims')} c USING (claim_id)), s AS (SELECT section_id, source_id, page_end, text AS t, {Q.normalise('text')} AS nt FROM {_t('source_sections')}),
        k AS (SELECT claim_id, min(CASE WHEN contains(t, q) THEN 0 WHEN contains(nt, nq) THEN 1 END) AS kind FROM e JOIN s USING (source_id) WHERE nq <> '' GROUP BY 1), m AS (SELECT source_id, coalesce(max(page_end), 0) AS last, bool_or(length(t) > 0) AS has FROM s GROUP BY 1),
        l AS (SELECT claim_id, page, section_id FROM {_t('claim_locators')} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY locator_id) = 1)
        SELECT e.claim_id, CASE kind WHEN 0 THEN 'exact' WHEN 1 THEN 'normalised' ELSE 'not_found' END AS status, CASE WHEN has THEN array_to_string(list_filter([
          CASE WHEN coalesce(nq, '') = '' THEN 'empty quote' WHEN kind IS NULL THEN 'quote not found' END, CASE WHEN page < 1 THEN 'page invalid' WHEN page > last THEN 'page beyond the last' END,
          CASE WHEN l.section_id IS NOT NULL AND (SELECT source_id FROM s WHERE s.section_id = l.section_id) IS DISTINCT FROM e.source_id THEN 'section not of the source' END,
          CASE WHEN claim_type <> '' AND claim_type NOT IN ({', '.join(map(repr, validation.CLAIM_TYPES))}) THEN 'type unknown' END], lambda x: x IS NOT NULL), '; ') ELSE 'no text' END AS errors
        FROM e LEFT JOIN k USING (claim_id) LEFT JOIN m ON m.source_id = e.source_id LEFT JOIN l ON l.claim_id = e.claim_id""",
    "sta8_persisted": f"SELECT c.claim_id, CASE quote_match_status WHEN 'exact' THEN 'high' ELSE 'medium' END AS confidence, coalesce(nullif(l.page, 0), s.page_start, -1) AS page FROM {_t('source_claims')} c LEFT JOIN (SELECT claim_id, page, section_id FROM {_t('claim_locators')} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY locator_id) = 1) l USING (claim_id) LEFT JOIN {_t('source_sections')} s ON s.section_id = l.section_id WHERE quote_match_status IN ('exact', 'normalised')",
    "sta9_first_sections": "SELECT source_id, sequence_number, section_id, text_sha256 FROM source_sections WHERE source_id IS NOT NULL AND sequence_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, sequence_number ORDER BY received_at, section_id) = 1",
    "int8_checks": f"""WITH c AS (SELECT count(*) FILTER (WHERE coalesce(source_quote, '') = '') AS nq, count(*) FILTER (WHERE origin_scope IS DISTINCT FROM 'external') AS ne, count(*) FILTER (WHERE scientific_verification_status IS DISTINCT FROM 'unverified') AS nu, count(*) FILTER (WHERE record_review_status IN ('approved', 'approved_with_edits')) AS ap, count(*) FILTER (WHERE record_review_status IN ('approved', 'approved_with_edits') AND len({_TOKENS}) > 0) AS ix FROM {_t('source_claims')}),
        l AS (SELECT count(*) FILTER (WHERE page IS NULL) AS np, count(DISTINCT claim_id) FILTER (WHERE page IS NOT NULL) AS tr FROM {_t('claim_locators')}), s AS (SELECT count(*) AS n FROM {_t('sources')} WHERE origin_scope IS DISTINCT FROM 'external'),
        f AS (SELECT count(*) AS n FROM (SELECT original_file_sha256 FROM {_t('sources')} WHERE original_file_sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)), o AS (SELECT count(*) AS n FROM ({PROBLEMS['p3_found']}))
        SELECT 'quotes present' AS check_name, nq AS counted, nq = 0 AS passed FROM c UNION ALL SELECT 'origin isolated', ne, ne = 0 FROM c UNION ALL SELECT 'claims unverified', nu, nu = 0 FROM c UNION ALL SELECT 'approved claims indexed', ix, ix = ap FROM c
        UNION ALL SELECT 'locators with page', np, np = 0 FROM l UNION ALL SELECT 'quotes traced', tr, tr > 0 FROM l UNION ALL SELECT 'sources external', n, n = 0 FROM s UNION ALL SELECT 'files taken in once', n, n = 0 FROM f UNION ALL SELECT 'references live', n, n = 0 FROM o""",
    "txt7_prompts": f"SELECT request_id, length(p) AS n_chars, sha256(p) AS prompt_sha256 FROM (SELECT request_id, 'Task: ' || coalesce(task_description, '') || chr(10) || 'Heading: ' || coalesce(section_heading, '') || chr(10) || chr(10) || coalesce(section_text, '') AS p FROM {_t('extraction_requests')})",
    "fts3_index_update": f"SELECT term, count(*) AS n_records, CAST(sum(tf) AS BIGINT) AS n_occurrences FROM (SELECT term, claim_id, count(*) AS tf FROM (SELECT claim_id, unnest({_TOKENS}) AS term FROM {_AFTER}) GROUP BY ALL) GROUP BY term",
}
