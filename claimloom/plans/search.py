"""Queries of keyword search and of conformance with annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.durable import file_system, temporary, written
from claimloom.operators import evaluation, search
from claimloom.plans import sqltext as Q
from claimloom.plans.joins import _t, records

FIELDS = ["source_quote", "faithful_paraphrase", "evidence_basis_description"]
#: The queries run here.
WORDS, MORE = "authors report", "swelling"


def _index(spark: SparkSession, d: str) -> DataFrame:
    approved = records(spark, d, "source_claims").where(F.col("record_review_status").isin("approved", "approved_with_edits"))
    return search.indexed(approved, "claim_id", FIELDS)


def fts2_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """FTS-1, FTS-2, FTS-3, STA-10: terms of approved claims with their records and occurrences."""
    return search.term_stats(search.postings(_index(spark, d)))


#: The index written for each data folder of a session.
_WRITTEN: dict[tuple[str, str], str] = {}


def _written(spark: SparkSession, d: str) -> str:
    """The folder of the index over approved claims, written by the first query that needs it."""
    key = spark.sparkContext.applicationId, d
    if key in _WRITTEN:
        fs, place = file_system(spark, _WRITTEN[key])
        if fs.exists(place):
            return _WRITTEN[key]
    _WRITTEN[key] = search.write_index(written(_index(spark, d), "terms"), temporary(spark, "index"))
    return _WRITTEN[key]


def fts5_bm25(spark: SparkSession, d: str) -> DataFrame:
    """FTS-4, FTS-5, JOIN-18, SRT-4: the best 20 claims with all words of a query."""
    return search.bm25(spark, _written(spark, d), WORDS).select("record_id", F.round("score", 9).alias("score"))


def fts6_results(spark: SparkSession, d: str) -> DataFrame:
    """FTS-6, JOIN-4: found claims with their texts and statuses, their source, first locator and its section."""
    hits = search.bm25(spark, _written(spark, d), MORE).select(F.col("record_id").alias("claim_id"), F.round("score", 9).alias("score"))
    c = records(spark, d, "source_claims").select("claim_id", "source_id", *FIELDS, "claim_type", "record_review_status", "scientific_verification_status", "origin_scope")
    s = records(spark, d, "sources").select("source_id", F.col("title").alias("source_title"))
    at = records(spark, d, "claim_locators").groupBy("claim_id").agg(F.min_by(F.struct("page", "section_id"), "locator_id").alias("l")).select("claim_id", "l.*")
    x = records(spark, d, "source_sections").select("section_id", F.col("heading").alias("section_heading"))
    rows = hits.join(c, "claim_id").join(s, "source_id", "left").join(at, "claim_id", "left").join(x, "section_id", "left")
    return rows.select("claim_id", "score", *FIELDS, "claim_type", "record_review_status", "scientific_verification_status", "origin_scope", "source_id", "source_title", F.coalesce("page", F.lit(-1)).alias("page"), "section_id", "section_heading")


def str19_probe_words(spark: SparkSession, d: str) -> DataFrame:
    """STR-19: the words of each approved claim's quote by which its index is probed."""
    c = records(spark, d, "source_claims").where("record_review_status IN ('approved', 'approved_with_edits')")
    return c.select("claim_id", F.array_join(search.probe_words(F.col("source_quote")), " ").alias("words"))


def fts8_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """FTS-8: a digest of the whole index by term, order-free."""
    from claimloom.operators.digests import multiset_digest

    posts = search.postings(_index(spark, d)).select(F.sha2(F.concat_ws("\x1f", "term", "record_id", F.col("tf").cast("string")), 256).alias("h"))
    return posts.agg(*multiset_digest(F.col("h")))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """The claims with what evaluation reads of them, once each."""
    return written(records(spark, d, "source_claims").select("claim_id", "source_quote", "claim_type", "author_hedging", "scope_description", "faithful_paraphrase", "record_review_status"), "claims")


def _annotations(c: DataFrame) -> DataFrame:
    """The claims not yet reviewed stand for annotations; those rejected by matching are negatives."""
    return c.where("record_review_status IN ('pending', 'rejected')").select(F.col("claim_id").alias("annotation_id"), "source_quote", "claim_type", "author_hedging", "scope_description", (F.col("record_review_status") == "pending").alias("must_extract"))


def _extracted(c: DataFrame) -> DataFrame:
    return c.where(F.col("record_review_status").isin("approved", "approved_with_edits"))


def _metrics(spark: SparkSession, d: str, c: DataFrame) -> DataFrame:
    a, found = _annotations(c), _extracted(c)
    at = records(spark, d, "claim_locators").groupBy("claim_id").agg(F.min("page").alias("page"))
    return evaluation.metrics(a, found.join(at, "claim_id", "left"), written(evaluation.best_matches(a, found), "matches"))


def evl1_best_match(spark: SparkSession, d: str) -> DataFrame:
    """EVL-1, JOIN-15: the first extracted claim that covers each annotation."""
    c = _claims(spark, d)
    return evaluation.best_matches(_annotations(c), _extracted(c))


def evl2_metrics(spark: SparkSession, d: str) -> DataFrame:
    """EVL-2, AGG-9, MTH-2: what was expected and met."""
    return _metrics(spark, d, _claims(spark, d))


def _unsupported(c: DataFrame) -> DataFrame:
    return evaluation.unsupported(_annotations(c), _extracted(c)).agg(F.count("*").alias("n"))


def evl3_unsupported(spark: SparkSession, d: str) -> DataFrame:
    """EVL-3: extracted claims whose quote is no positive annotation's and holds no negative one's."""
    return _unsupported(_claims(spark, d))


def evl4_gate(spark: SparkSession, d: str) -> DataFrame:
    """EVL-4: each metric against its threshold."""
    c = _claims(spark, d)
    return evaluation.gate(_metrics(spark, d, c), _unsupported(c))


QUERIES = {f.__name__: f for f in (fts2_term_stats, fts5_bm25, fts6_results, fts8_fingerprint, str19_probe_words, evl1_best_match, evl2_metrics, evl3_unsupported, evl4_gate)}

_TOKENS = "regexp_extract_all(lower(strip_accents(concat_ws(chr(10), source_quote, faithful_paraphrase, evidence_basis_description))), '[\\p{L}\\p{N}]+')"
_IX = f"ix AS (SELECT claim_id AS record_id, {_TOKENS} AS terms FROM {_t('source_claims')} WHERE record_review_status IN ('approved', 'approved_with_edits')), po AS (SELECT term, record_id, count(*) AS tf FROM (SELECT record_id, unnest(terms) AS term FROM ix) GROUP BY ALL)"


def _bm25(query: str) -> str:
    terms = ", ".join(f"'{t}'" for t in search.query_terms(query))
    n = len(search.query_terms(query))
    return f"""WITH {_IX}, st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM ix), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
    sc AS (SELECT record_id, count(*) AS k, round(sum(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / avgdl))), 9) AS score FROM po JOIN df USING (term) JOIN ix USING (record_id), st WHERE term IN ({terms}) GROUP BY 1),
    hits AS (SELECT record_id, score FROM sc WHERE k = {n} ORDER BY score, record_id LIMIT 20) """


def _words(x: str, more: int) -> str:
    return f"list_filter(string_split({Q.collapse(Q.strip(f'lower({x})'))}, ' '), lambda w: length(w) > {more})"


_EVL = f"""WITH a AS (SELECT claim_id AS annotation_id, source_quote, claim_type, author_hedging, scope_description, record_review_status = 'pending' AS must_extract, {Q.strip('lower(source_quote)')} AS tq, {_words('source_quote', 2)} AS w FROM {_t('source_claims')} WHERE record_review_status IN ('pending', 'rejected')),
p AS (SELECT claim_id, min(page) AS page FROM {_t('claim_locators')} GROUP BY 1),
c AS (SELECT c.*, p.page, {Q.strip('lower(source_quote)')} AS sq FROM {_t('source_claims')} c LEFT JOIN p USING (claim_id) WHERE record_review_status IN ('approved', 'approved_with_edits')),
m AS (SELECT annotation_id, min(claim_id) AS claim_id FROM a, c WHERE tq <> '' AND (contains(sq, tq) OR len(w) > 0 AND len(list_filter(w, lambda v: contains(sq, v))) / len(w) >= 0.7) GROUP BY 1),
j AS (SELECT a.*, m.claim_id IS NOT NULL AS hit, c.source_quote AS cq, c.claim_type AS ct, c.page AS cp, c.author_hedging AS ch, c.faithful_paraphrase AS cf, c.scope_description AS cs FROM a LEFT JOIN m USING (annotation_id) LEFT JOIN c ON c.claim_id = m.claim_id),
x AS (SELECT count(*) FILTER (WHERE must_extract) AS positives, count(*) FILTER (WHERE NOT must_extract) AS negatives, count(*) FILTER (WHERE must_extract AND hit) AS recall_n, count(*) FILTER (WHERE NOT must_extract AND hit) AS negative_n,
 count(*) FILTER (WHERE must_extract AND source_quote <> '') AS quote_d, count(*) FILTER (WHERE must_extract AND hit AND {Q.strip('cq')} <> '') AS quote_n, count(*) FILTER (WHERE must_extract AND hit AND cp IS NOT NULL) AS locator_n,
 count(*) FILTER (WHERE must_extract AND claim_type <> '') AS type_d, count(*) FILTER (WHERE must_extract AND hit AND ct = claim_type) AS type_n,
 count(*) FILTER (WHERE must_extract AND author_hedging <> '') AS hedging_d, count(*) FILTER (WHERE must_extract AND hit AND author_hedging <> '' AND (coalesce(ch, '') <> '' OR {' OR '.join(f"contains(lower(cf), '{h}')" for h in evaluation.HEDGES)})) AS hedging_n,
 count(*) FILTER (WHERE must_extract AND scope_description <> '') AS scope_d, count(*) FILTER (WHERE must_extract AND hit AND scope_description <> '' AND cs <> '') AS scope_n FROM j),
u AS (SELECT count(*) AS n FROM c WHERE {Q.strip('source_quote')} <> '' AND {Q.strip('source_quote')} NOT IN (SELECT {Q.strip('source_quote')} FROM a WHERE must_extract)
  AND NOT EXISTS (SELECT 1 FROM a WHERE NOT must_extract AND {Q.strip('a.source_quote')} <> '' AND contains({Q.strip('c.source_quote')}, {Q.strip('a.source_quote')}))) """
_GATE = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CASE WHEN {d} = 0 THEN 100.0 ELSE round({n} * 100 / {d}, 1) END AS value, {evaluation.THRESHOLDS.get(m, 0)}.0 AS threshold FROM x"
    for m, n, d in (("recall", "recall_n", "positives"), ("type_accuracy", "type_n", "type_d"), ("hedging_preservation", "hedging_n", "hedging_d"), ("scope_preservation", "scope_n", "scope_d"), ("quote_match", "quote_n", "quote_d"), ("locator_completeness", "locator_n", "positives"), ("negative_extraction", "negative_n", "negatives"))
)

SQL = {
    "fts2_term_stats": f"WITH {_IX} SELECT term, count(*) AS n_records, CAST(sum(tf) AS BIGINT) AS n_occurrences FROM po GROUP BY term",
    "fts5_bm25": _bm25(WORDS) + "SELECT * FROM hits",
    "fts6_results": _bm25(MORE) + f""", l AS (SELECT claim_id, page, section_id FROM {_t('claim_locators')} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY locator_id) = 1)
        SELECT h.record_id AS claim_id, h.score, {', '.join('c.' + x for x in FIELDS)}, c.claim_type, c.record_review_status, c.scientific_verification_status, c.origin_scope, c.source_id, s.title AS source_title, coalesce(l.page, -1) AS page, l.section_id, ss.heading AS section_heading
        FROM hits h JOIN {_t('source_claims')} c ON c.claim_id = h.record_id LEFT JOIN {_t('sources')} s ON s.source_id = c.source_id LEFT JOIN l ON l.claim_id = h.record_id LEFT JOIN {_t('source_sections')} ss ON ss.section_id = l.section_id""",
    "str19_probe_words": f"""SELECT claim_id, array_to_string(list_filter(list_transform(list_filter(string_split({Q.collapse(Q.strip('source_quote'))}, ' '), lambda w: length(w) > 0)[1:3], lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda w: length(w) > 2 AND lower(w) NOT IN ({', '.join(map(repr, search.STOP_WORDS))})), ' ') AS words
        FROM {_t('source_claims')} WHERE record_review_status IN ('approved', 'approved_with_edits')""",
    "fts8_fingerprint": f"WITH {_IX} SELECT count(*) AS n_rows, {Q.lane('h', 1)} AS digest_a, {Q.lane('h', 16)} AS digest_b FROM (SELECT sha256(concat_ws(chr(31), term, record_id, CAST(tf AS VARCHAR))) AS h FROM po)",
    "evl1_best_match": _EVL + "SELECT annotation_id, claim_id FROM m",
    "evl2_metrics": _EVL + "SELECT * FROM x",
    "evl3_unsupported": _EVL + "SELECT n FROM u",
    "evl4_gate": _EVL + f"SELECT metric, CAST(value AS DOUBLE) AS value, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN metric IN ('negative_extraction', 'unsupported_accepted') THEN value <= threshold ELSE value >= threshold END AS passed FROM ({_GATE} UNION ALL SELECT 'unsupported_accepted', n, 0.0 FROM u)",
}
