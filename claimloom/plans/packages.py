"""Queries over whole tables: digests, manifests, snapshots, rebuilding, and what is written for people and programs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.durable import temporary, written
from claimloom.operators import digests, merging, orphans, segments
from claimloom.plans import sqltext as Q
from claimloom.plans.joins import ALL_REFERENCES, IDS, _key, _t, records
from claimloom.plans.texts import SQL as TEXTS
from claimloom.sources import sinks, snapshots
from claimloom.sources.tables import table

#: The columns of the tables but the time of receipt, which is the delivery's and not the record's.
COLUMNS = {
    "sources": "source_id source_type title authors_json organisation publication_date doi language version_label original_file_sha256 origin_scope scientific_verification_status created_at updated_at subject_domain",
    "source_claims": "claim_id source_id task_id claim_type source_quote faithful_paraphrase evidence_basis_description scope_description author_hedging origin_scope record_review_status scientific_verification_status quote_match_status created_by_run_id created_at updated_at",
    "source_sections": "section_id source_id section_type heading page_start page_end sequence_number text parser_name parser_version text_sha256",
    "claim_locators": "locator_id claim_id section_id page paragraph_index figure_label table_label supplementary_label character_start character_end locator_confidence",
    "processing_runs": "run_id task_id source_id module_name model_name model_mode prompt_version parser_name parser_version code_commit input_hash output_hash status error_type error_message started_at completed_at",
    "review_batches": "review_batch_id run_id source_id packet_sha256 status exported_at completed_at",
    "review_batch_rows": "review_row_id review_batch_id claim_id row_sequence row_input_sha256 applied_at",
    "claim_revisions": "revision_id claim_id previous_content_json new_content_json changed_by change_reason created_at",
    "extraction_requests": "request_id section_id source_id task_description section_text section_heading page_start page_end section_type",
    "raw_claim_records": "raw_id payload",
}
#: Times, which digests of contents leave out; the note on every exported claim; the columns of a review packet, the last nine for the reviewer.
TIMES = ("created_at", "updated_at", "started_at", "completed_at", "exported_at", "applied_at")
NOTE = "External source, scientific status: unverified"
PACKET = (
    "review_batch_id", "review_row_id", "row_input_sha256", "packet_sha256", "run_id", "claim_id", "source_id", "source_title", "source_relative_path", "claim_type", "source_quote", "context_before", "context_after",
    "faithful_paraphrase", "evidence_basis_description", "page", "section_id", "section_heading", "figure_label", "table_label", "quote_match_status", "locator_confidence", "model_name", "model_mode", "prompt_version",
    "parser_name", "code_commit", "record_review_status", "scientific_verification_status",
)
DECISION = ("decision", "edited_source_quote", "edited_faithful_paraphrase", "edited_evidence_basis_description", "edited_claim_type", "edited_page", "edited_section", "review_reason", "reviewer")
#: How each table's records belong to a source: their own column, or by way of another table's key.
SCOPE = {"sources": None, "source_claims": None, "source_sections": None, "processing_runs": None, "review_batches": None, "extraction_requests": None, "claim_locators": ("source_claims", "claim_id"), "claim_revisions": ("source_claims", "claim_id"), "review_batch_rows": ("review_batches", "review_batch_id")}
_APPROVED = "record_review_status IN ('approved', 'approved_with_edits')"


def _whole(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The records of a table with all their columns but the time of receipt."""
    return records(spark, d, name).drop("received_at")


def _contents(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in TIMES]


def int3_summary(spark: SparkSession, d: str) -> DataFrame:
    """INT-3, INT-4, DAT-2: per table, rows, a digest of ids, one of all contents without times, and claims by review status."""
    parts = [digests.summary(r, t, IDS[t], _contents(r)) for t in IDS for r in [_whole(spark, d, t)]]
    n = records(spark, d, "source_claims").groupBy("record_review_status").agg(F.count("*").alias("n")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", F.coalesce("record_review_status", F.lit("")), "n"))), ",").alias("review_counts"))
    return reduce(DataFrame.union, parts).join(n.withColumn("table_name", F.lit("source_claims")), "table_name", "left")


def int5_tables(spark: SparkSession, d: str) -> DataFrame:
    """INT-5, JOIN-17: what differs between two sets of tables, one for each table of the first and of the last snapshot."""
    shots = table(spark, d, "claim_snapshots")
    order = shots.select("snapshot_id", "taken_at").distinct()
    ends = order.agg(F.min_by("snapshot_id", F.struct("taken_at", "snapshot_id")).alias("a"), F.max_by("snapshot_id", F.struct("taken_at", "snapshot_id")).alias("b"))
    sides = []
    for side, others in (("a", ("sources", "review_batches")), ("b", ("sources", "processing_runs"))):
        of = shots.join(ends.select(F.col(side).alias("snapshot_id")), "snapshot_id").drop("snapshot_id", "taken_at").distinct()
        parts = [digests.summary(of, "claims", "claim_id", _contents(of)), *(digests.summary(r, t, IDS[t], _contents(r)) for t in others for r in [_whole(spark, d, t)])]
        sides.append(reduce(DataFrame.union, parts))
    return digests.compare_sets(*sides)


def snk9_manifest(spark: SparkSession, d: str) -> DataFrame:
    """SNK-9, INT-1: per source, records and a digest of all their columns for each kind, as a snapshot's manifest lists them."""
    parts = []
    for name, way in SCOPE.items():
        r = _whole(spark, d, name)
        h = r.select(*([way[1]] if way else ["source_id"]), digests.row_hash(r.columns).alias("h"))
        if way:
            h = h.join(records(spark, d, way[0]).select(way[1], "source_id"), way[1])
        parts.append(h.where("source_id IS NOT NULL").select("source_id", F.lit(name).alias("record_type"), "h"))
    return reduce(DataFrame.union, parts).groupBy("source_id", "record_type").agg(*digests.multiset_digest(F.col("h")))


def int1_snapshot_check(spark: SparkSession, d: str) -> DataFrame:
    """SNK-9, SNK-12, INT-1, INT-7: all tables written as a version, read back, checked against the manifest, then their references to each other."""
    root = temporary(spark, "snapshots")
    snapshots.write({t: records(spark, d, t) for t in IDS}, root)
    stored = snapshots.read(spark, root)
    rows = snapshots.manifest({t: df.drop("received_at") for t, df in stored.items()}).select("table_name", "n_rows", "digest_a").join(snapshots.check(spark, root), "table_name")
    dead = orphans.orphans(stored, table(spark, d, "deletion_log").limit(0), ALL_REFERENCES).groupBy("table_name").agg(F.count_distinct("field_name", "record_id").alias("n_dead"))
    return rows.join(dead, "table_name", "left").select("table_name", "n_rows", "digest_a", F.coalesce("problem", F.lit("none")).alias("problem"), F.coalesce("n_dead", F.lit(0)).alias("n_dead"))


def int2_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """INT-2, AGG-14: claims rebuilt from all snapshots as packages, in order of time: the first package that has a claim wins; conflicts are told."""
    shots = table(spark, d, "claim_snapshots").distinct()
    return merging.imported(shots, ["claim_id"], ["taken_at", "snapshot_id"]).where("claim_id IS NOT NULL").select("claim_id", "snapshot_id", "n_rows", "is_conflict")


def snk1_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1, SRC-3: claims with all columns written as JSON lines and read back."""
    return sinks.round_trip(_whole(spark, d, "source_claims"), "jsonl")


def snk8_export(spark: SparkSession, d: str) -> DataFrame:
    """SNK-8: approved claims with all columns, their page and a note, written as JSON lines and read back."""
    page = records(spark, d, "claim_locators").groupBy("claim_id").agg(F.min_by("page", "locator_id").alias("page"))
    rows = _whole(spark, d, "source_claims").where(_APPROVED).join(page, "claim_id", "left").withColumn("_note", F.lit(NOTE))
    return sinks.round_trip(rows, "jsonl")


def _packet(spark: SparkSession, d: str) -> DataFrame:
    """Each row of each review batch with its claim, first locator, source, section and run, and the words around the quote."""
    r = records(spark, d, "review_batch_rows").select("review_row_id", "review_batch_id", "claim_id", "row_input_sha256")
    b = records(spark, d, "review_batches").select("review_batch_id", "packet_sha256", "run_id")
    c = records(spark, d, "source_claims").select("claim_id", "source_id", "claim_type", "source_quote", "faithful_paraphrase", "evidence_basis_description", "quote_match_status", "record_review_status", "scientific_verification_status", "created_by_run_id")
    at = records(spark, d, "claim_locators").groupBy("claim_id").agg(F.min_by(F.struct("page", "section_id", "figure_label", "table_label", "locator_confidence"), "locator_id").alias("l")).select("claim_id", "l.*")
    s = records(spark, d, "sources").select("source_id", F.col("title").alias("source_title"))
    x = records(spark, d, "source_sections").select("section_id", F.col("heading").alias("section_heading"), "text")
    m = records(spark, d, "processing_runs").select(F.col("run_id").alias("created_by_run_id"), "model_name", "model_mode", "prompt_version", "parser_name", "code_commit")
    # A claim's context is made once, however many batches it is in.
    claims = c.join(at, "claim_id", "left").join(x, "section_id", "left").withColumn("at", segments.place(F.col("text"), F.col("source_quote")))
    around = F.when(F.col("at") >= 0, segments.context(F.col("text"), F.col("at"), F.length("source_quote")))
    claims = claims.select("*", around.alias("x")).withColumns({"context_before": F.coalesce("x.before", F.lit("")), "context_after": F.coalesce("x.after", F.lit(""))}).drop("text", "x", "at")
    rows = r.join(b, "review_batch_id").join(claims, "claim_id").join(s, "source_id", "left").join(m, "created_by_run_id", "left")
    return rows.withColumns({"page": F.col("page").cast("string"), "source_relative_path": F.lit("")}).select(*PACKET)


def snk4_csv(spark: SparkSession, d: str) -> DataFrame:
    """SNK-4, SRC-5, JOIN-4: review packets as CSV of 38 columns, the reviewer's blank, with line breaks and quotes inside, read back; what is missing is blank."""
    rows = _packet(spark, d).select(*(F.coalesce(c, F.lit("")).alias(c) for c in PACKET), *(F.lit("").alias(c) for c in DECISION))
    return sinks.round_trip(rows, "csv")


def snk5_packets(spark: SparkSession, d: str) -> DataFrame:
    """SNK-5: review packets as JSON lines, what is missing being null, read back."""
    return sinks.round_trip(_packet(spark, d), "jsonl")


def _lines(*parts: Column | str) -> Column:
    """Lines of text of columns and literals, NULL being empty."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _item(label: str, x: Column) -> Column:
    return F.concat(F.lit(f"- **{label}:** "), F.coalesce(x.cast("string"), F.lit("")))


def snk7_export(spark: SparkSession, d: str) -> DataFrame:
    """SNK-7, SRT-3: each source's Markdown as blocks in their order: a header, its approved claims by page and type, a summary with what was rejected.

    Blocks stay rows, to be written one after another; a source with a third of all claims is no single string.
    """
    c = records(spark, d, "source_claims").where("source_id IS NOT NULL")
    at = records(spark, d, "claim_locators").groupBy("claim_id").agg(F.min_by("page", "locator_id").alias("page"))
    n = c.groupBy("source_id").agg(F.count_if(F.expr(_APPROVED)).alias("approved"), F.count_if(F.col("record_review_status") == "rejected").alias("rejected"))
    s = written(records(spark, d, "sources").join(n, "source_id", "left").fillna(0, ["approved", "rejected"]), "headers")
    title = F.coalesce(F.nullif("title", F.lit("")), "source_id")
    header = _lines(
        F.concat(F.lit("# Source Record: "), title, F.lit("\n")), "## Source Identity\n", _item("Source ID", F.col("source_id")), _item("Type", F.col("source_type")), _item("SHA-256", F.col("original_file_sha256")),
        "- **Origin:** External", F.concat(_item("Scientific Verification", F.col("scientific_verification_status")), F.lit("\n")), f"> {NOTE}\n", F.concat(F.lit("## Claims ("), "approved", F.lit(" approved)\n")),
    )
    summary = _lines("## Summary\n", _item("Approved claims", F.col("approved")), _item("Rejected claims", F.col("rejected")), f"- **{NOTE}**\n")
    quoted = lambda label, x: F.concat(F.lit(label), F.coalesce(x, F.lit("")), F.lit("\n"))
    claim = _lines(
        F.concat(F.lit("### "), "claim_id", F.lit("\n")), _item("Type", F.col("claim_type")), _item("Page", F.coalesce(F.col("page").cast("string"), F.lit("N/A"))), F.concat(_item("Review", F.col("record_review_status")), F.lit("\n")),
        quoted("> ", F.col("source_quote")), quoted("**Paraphrase:** ", F.col("faithful_paraphrase")), quoted("**Evidence:** ", F.col("evidence_basis_description")), F.when(F.col("author_hedging") != "", F.concat(F.lit("**Author Hedging:** `"), "author_hedging", F.lit("`\n"))), "---\n",
    )
    none = F.lit(None).cast("int")
    blocks = [s.select("source_id", F.lit(place).alias("place"), none.alias("page"), F.lit("").alias("record_id"), text.alias("markdown")) for place, text in ((0, header), (2, summary))]
    approved = c.where(_APPROVED).join(at, "claim_id", "left").join(s.select("source_id"), "source_id", "left_semi")
    blocks.append(approved.select("source_id", F.lit(1).alias("place"), "page", F.col("claim_id").alias("record_id"), claim.alias("markdown")))
    return reduce(DataFrame.unionByName, blocks).select("source_id", "place", "page", "record_id", F.sha2("markdown", 256).alias("markdown_sha256"))


QUERIES = {f.__name__: f for f in (int1_snapshot_check, int2_rebuild, int3_summary, int5_tables, snk1_jsonl, snk4_csv, snk5_packets, snk7_export, snk8_export, snk9_manifest)}

_ALL = {t: c.split() for t, c in COLUMNS.items()}


def _summary(name: str, rows: str, key: str, columns: list[str]) -> str:
    return f"""SELECT '{name}' AS table_name, count(*) AS n_rows, {Q.lane('i', 1)} AS id_digest, {Q.lane('h', 1)} || '-' || {Q.lane('h', 16)} AS content_digest
        FROM (SELECT sha256({Q.canonical_row([key])}) AS i, sha256({Q.canonical_row([c for c in columns if c not in TIMES])}) AS h FROM {rows})"""


_SHOT = ["claim_id", "source_id", "claim_type", "record_review_status", "quote_match_status", "author_hedging", "updated_at"]


def _side(order: str, others: tuple[str, ...]) -> str:
    shot = f"(SELECT DISTINCT {', '.join(_SHOT)} FROM claim_snapshots WHERE snapshot_id = (SELECT snapshot_id FROM claim_snapshots ORDER BY taken_at {order}, snapshot_id {order} LIMIT 1))"
    return " UNION ALL ".join([_summary("claims", shot, "claim_id", _SHOT), *(_summary(t, _t(t), IDS[t], _ALL[t]) for t in others)])


def _scoped(name: str, way: tuple[str, str] | None) -> str:
    rows = f"SELECT {way[1] if way else 'source_id'}, sha256({Q.canonical_row(_ALL[name])}) AS h FROM {_t(name)}"
    rows = f"SELECT source_id, h FROM ({rows}) JOIN (SELECT {way[1]}, source_id FROM {_t(way[0])}) USING ({way[1]})" if way else rows
    return f"SELECT source_id, '{name}' AS record_type, h FROM ({rows}) WHERE source_id IS NOT NULL"


_DEAD = " UNION ALL ".join(f"SELECT '{r.table}' AS t, '{r.field}' AS f, {r.record_id} AS i FROM {r.table} WHERE {r.record_id} IS NOT NULL AND {_key(r.field)} NOT IN (SELECT {_key(r.parent_key)} FROM {r.parent} WHERE {r.parent_key} IS NOT NULL)" for r in ALL_REFERENCES)
_PAGE = f"(SELECT claim_id, page FROM {_t('claim_locators')} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY locator_id) = 1)"
_PACKET = f"""WITH x AS ({TEXTS['str13_quote_context']}), l AS (SELECT * FROM {_t('claim_locators')} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY locator_id) = 1),
    p AS (SELECT r.review_batch_id, r.review_row_id, r.row_input_sha256, b.packet_sha256, b.run_id, c.claim_id, c.source_id, s.title AS source_title, '' AS source_relative_path, c.claim_type, c.source_quote, coalesce(x.before, '') AS context_before, coalesce(x.after, '') AS context_after,
      c.faithful_paraphrase, c.evidence_basis_description, CAST(l.page AS VARCHAR) AS page, l.section_id, ss.heading AS section_heading, l.figure_label, l.table_label, c.quote_match_status, l.locator_confidence, m.model_name, m.model_mode, m.prompt_version,
      m.parser_name, m.code_commit, c.record_review_status, c.scientific_verification_status
      FROM {_t('review_batch_rows')} r JOIN {_t('review_batches')} b USING (review_batch_id) JOIN {_t('source_claims')} c ON c.claim_id = r.claim_id LEFT JOIN l ON l.claim_id = c.claim_id LEFT JOIN x ON x.locator_id = l.locator_id
      LEFT JOIN {_t('sources')} s ON s.source_id = c.source_id LEFT JOIN {_t('source_sections')} ss ON ss.section_id = l.section_id LEFT JOIN {_t('processing_runs')} m ON m.run_id = c.created_by_run_id) """


def _md(*lines: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(lines) + ")"


def _li(label: str, x: str) -> str:
    return f"'- **{label}:** ' || coalesce(CAST({x} AS VARCHAR), '')"


_HEADER = _md("'# Source Record: ' || coalesce(nullif(title, ''), source_id) || chr(10)", "'## Source Identity' || chr(10)", _li("Source ID", "source_id"), _li("Type", "source_type"), _li("SHA-256", "original_file_sha256"), "'- **Origin:** External'", _li("Scientific Verification", "scientific_verification_status") + " || chr(10)", f"'> {NOTE}' || chr(10)", "'## Claims (' || approved || ' approved)' || chr(10)")
_CLAIM = _md("'### ' || claim_id || chr(10)", _li("Type", "claim_type"), _li("Page", "coalesce(CAST(page AS VARCHAR), 'N/A')"), _li("Review", "record_review_status") + " || chr(10)", *(f"'{label}' || coalesce({x}, '') || chr(10)" for label, x in (("> ", "source_quote"), ("**Paraphrase:** ", "faithful_paraphrase"), ("**Evidence:** ", "evidence_basis_description"))), "CASE WHEN author_hedging <> '' THEN '**Author Hedging:** `' || author_hedging || '`' || chr(10) END", "'---' || chr(10)")
_SUMMARY = _md("'## Summary' || chr(10)", _li("Approved claims", "approved"), _li("Rejected claims", "rejected"), f"'- **{NOTE}**' || chr(10)")

SQL = {
    "int1_snapshot_check": f"WITH dead AS (SELECT t, count(DISTINCT (f, i)) AS n FROM ({_DEAD}) GROUP BY 1), m AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, {Q.lane('h', 1)} AS digest_a FROM (SELECT sha256({Q.canonical_row(c)}) AS h FROM {_t(t)})" for t, c in _ALL.items()) + ") SELECT table_name, n_rows, digest_a, 'none' AS problem, coalesce(n, 0) AS n_dead FROM m LEFT JOIN dead ON t = table_name",
    "int2_rebuild": f"""WITH d AS (SELECT DISTINCT * FROM claim_snapshots WHERE claim_id IS NOT NULL), c AS (SELECT *, {Q.canonical_row(_SHOT[1:])} AS x FROM d)
        SELECT claim_id, arg_min(snapshot_id, (taken_at, snapshot_id)) AS snapshot_id, count(*) AS n_rows, count(DISTINCT x) > 1 AS is_conflict FROM c GROUP BY 1""",
    "int3_summary": f"WITH r AS (SELECT string_agg(coalesce(record_review_status, '') || '=' || n, ',' ORDER BY coalesce(record_review_status, '') || '=' || n) AS c FROM (SELECT record_review_status, count(*) AS n FROM {_t('source_claims')} GROUP BY 1)), m AS (" + " UNION ALL ".join(_summary(t, _t(t), IDS[t], c) for t, c in _ALL.items()) + ") SELECT m.*, CASE WHEN table_name = 'source_claims' THEN c END AS review_counts FROM m, r",
    "int5_tables": f"""WITH a AS ({_side('ASC', ('sources', 'review_batches'))}), b AS ({_side('DESC', ('sources', 'processing_runs'))})
        SELECT coalesce(a.table_name, b.table_name) AS table_name, CASE WHEN b.table_name IS NULL THEN 'only in a' WHEN a.table_name IS NULL THEN 'only in b' WHEN a.n_rows <> b.n_rows THEN 'count' WHEN a.id_digest <> b.id_digest THEN 'ids' ELSE 'content' END AS difference
        FROM a FULL JOIN b ON a.table_name = b.table_name WHERE a.table_name IS NULL OR b.table_name IS NULL OR a.n_rows <> b.n_rows OR a.id_digest <> b.id_digest OR a.content_digest <> b.content_digest""",
    "snk1_jsonl": f"SELECT {', '.join(_ALL['source_claims'])} FROM {_t('source_claims')}",
    "snk8_export": f"SELECT {', '.join('c.' + x for x in _ALL['source_claims'])}, page, '{NOTE}' AS _note FROM {_t('source_claims')} c LEFT JOIN {_PAGE} l ON l.claim_id = c.claim_id WHERE {_APPROVED}",
    "snk4_csv": _PACKET + f"SELECT {', '.join(f'coalesce({c}, {chr(39) * 2}) AS {c}' for c in PACKET)}, {', '.join(f'{chr(39) * 2} AS {c}' for c in DECISION)} FROM p",
    "snk5_packets": _PACKET + "SELECT * FROM p",
    "snk7_export": f"""WITH c AS (SELECT c.*, page FROM {_t('source_claims')} c LEFT JOIN {_PAGE} l USING (claim_id) WHERE source_id IS NOT NULL),
        s AS (SELECT s.*, (SELECT count(*) FROM c WHERE c.source_id = s.source_id AND {_APPROVED}) AS approved, (SELECT count(*) FROM c WHERE c.source_id = s.source_id AND record_review_status = 'rejected') AS rejected FROM {_t('sources')} s)
        SELECT source_id, 0 AS place, NULL AS page, '' AS record_id, sha256({_HEADER}) AS markdown_sha256 FROM s UNION ALL SELECT source_id, 2, NULL, '', sha256({_SUMMARY}) FROM s
        UNION ALL SELECT source_id, 1, page, claim_id, sha256({_CLAIM}) FROM c WHERE {_APPROVED} AND source_id IN (SELECT source_id FROM s)""",
    "snk9_manifest": f"SELECT source_id, record_type, count(*) AS n_rows, {Q.lane('h', 1)} AS digest_a, {Q.lane('h', 16)} AS digest_b FROM ({' UNION ALL '.join(_scoped(n, w) for n, w in SCOPE.items())}) GROUP BY 1, 2",
}
