"""Queries of the training-text problems (1 and 5 to 10), and SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.durable import written
from claimloom.llm import dupes, forms, mix, pack, spans, split, tokens
from claimloom.sources.tables import table


def _document_tokens(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``doc_id``, columns and ``n_tokens`` of all documents, counted once."""
    return written(tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", *columns, "text"), "text"), "document-tokens")


def p1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per source, language and domain, of sections and of documents."""
    return tokens.token_budget(*(table(spark, sf_dir, t) for t in ("source_sections", "sources", "documents")))


def p1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored count of every record."""
    return tokens.stored_counts(table(spark, sf_dir, "source_sections"), table(spark, sf_dir, "documents"))


FORMS = (("source_claims", "claim_id", "source_quote"), ("source_sections", "section_id", "text"))


def _look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = [forms.form_keys(table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.col(i).alias("record_id"), c), ["table_name", "record_id"], c) for t, i, c in FORMS]
    return forms.look_alike_classes(written(reduce(DataFrame.unionByName, keyed), "forms"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose texts look the same but differ."""
    return forms.look_alike_pairs(written(_look_alikes(spark, sf_dir), "alike"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with a look-alike, and the class of records that look like it."""
    return _look_alikes(spark, sf_dir).select("table_name", "record_id", F.col("form_key").alias("class_id"))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every quote and section."""
    rows = [forms.visual_forms(table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.col(i).alias("record_id"), c), ["table_name", "record_id"], c) for t, i, c in FORMS]
    return reduce(DataFrame.unionByName, rows).select("table_name", "record_id", "form")


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    claims, raw = table(spark, sf_dir, "source_claims"), table(spark, sf_dir, "raw_claim_records")
    fields = ["source_quote", "faithful_paraphrase"]
    rows = dupes.keyed(claims, "source_claims", "claim_id", fields).unionByName(dupes.keyed(dupes.claims_of_payloads(raw), "raw_claim_records", "raw_id", fields))
    return rows, claims.count() + raw.count()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of claims but for formatting, each with the smallest id of its group."""
    return dupes.copies(*_copies(spark, sf_dir))


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per different claim, with the number of its copies."""
    return dupes.collapsed(*_copies(spark, sf_dir))


def _long(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], str, int, int]:
    rows = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.col(i).alias("record_id"), F.col(c).alias("text")) for t, i, c in (("source_sections", "section_id", "text"), ("extraction_requests", "request_id", "section_text"))]
    return reduce(DataFrame.unionByName, rows), ["table_name", "record_id"], "text", *split.limit(table(spark, sf_dir, "size_limits"), "claim_chunk")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that had to be cut."""
    return split.cut(*_long(spark, sf_dir)).where(F.size("cores") > 1).select("table_name", "record_id").distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all records that had to be cut; a redelivered record is cut once."""
    return split.pieces(*_long(spark, sf_dir)).dropDuplicates(["table_name", "record_id", "piece_no"])


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    limits = table(spark, sf_dir, "size_limits").where("limit_name LIKE 'pack_%' AND unit = 'tokens'")
    return _document_tokens(spark, sf_dir), limits


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of every size."""
    return pack.packing(*_sizes(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, beside those of best fit alone."""
    return pack.fill(*_sizes(spark, sf_dir))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, with how often each is used."""
    return mix.mixture(_document_tokens(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    counts, targets = _document_tokens(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets")
    return mix.shares(mix.mixture(counts, targets), counts, targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of documents that also stand in another."""
    return spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in others."""
    documents = table(spark, sf_dir, "documents")
    return spans.shared_shares(documents, "doc_id", "text", spans.shared_spans(documents, "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_token_budget, p1_token_counts, p5_found, p5_classes, p5_forms, p6_found, p6_records, p7_found, p7_pieces, p8_packing, p8_fill, p9_mixture, p9_shares, p10_found, p10_shares)}

_WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _canonical(x: str) -> str:
    """RE2 has no look-around: marks between digits are shielded one after another, twice as digits may be shared."""
    shield = rf"regexp_replace({x}, '([0-9])(\p{{P}})([0-9])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"
    shield = rf"regexp_replace({shield}, '([0-9])(\p{{P}})([0-9])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"
    bare = rf"regexp_replace({shield}, '(^|[^' || chr(1) || '])\p{{P}}+', '\1', 'g')"
    return f"lower(regexp_replace(replace(replace({bare}, chr(1), ''), chr(2), ''), '{_WS}', '', 'g'))"


_COPIES = f"""WITH raw AS (SELECT raw_id, CASE WHEN json_exists(p, '$.claims') THEN p->'$.claims[0]' ELSE p END AS c FROM (SELECT raw_id, TRY_CAST(payload AS JSON) AS p FROM raw_claim_records) WHERE p IS NOT NULL),
r AS (SELECT 'source_claims' AS table_name, claim_id AS id, source_quote AS q, faithful_paraphrase AS f FROM source_claims
  UNION SELECT 'raw_claim_records', raw_id, c->>'$.source_quote', c->>'$.faithful_paraphrase' FROM raw),
k AS (SELECT DISTINCT table_name, id, {_canonical("q")} AS q, {_canonical("f")} AS f FROM r) """

def _form(x: str) -> str:
    """The form by one table of all mapped characters, letter by letter where one becomes several."""
    table = forms.mapping()
    single, several = ([c for c in table if (len(table[c]) == 1) == one] for one in (True, False))
    quoted = forms._quoted
    t = f"translate({x}, {quoted(''.join(single))}, {quoted(''.join(table[c] for c in single))})"
    letters = f"MAP([{', '.join(map(quoted, several))}], [{', '.join(quoted(table[c]) for c in several)}])"
    each = f"array_to_string(list_transform(regexp_extract_all({t}, '(?s).'), lambda c: coalesce({letters}[c], c)), '')"
    spelled = f"CASE WHEN regexp_matches({t}, {quoted('[' + ''.join(several) + ']')}) THEN {each} ELSE {t} END"
    return f"nfc_normalize(regexp_replace(replace({spelled}, chr(13) || chr(10), chr(10)), {quoted(forms.INVISIBLE)}, '', 'g'))"


_FORMS = "WITH f AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, {i} AS record_id, {c} AS text, {_form(c)} AS form FROM {t}" for t, i, c in FORMS) + "), d AS (SELECT DISTINCT * FROM f WHERE text IS NOT NULL) "

def _cut(most: str, least: str) -> str:
    """The length of the core that begins ``rest``: up to the last of the strongest boundaries between ``least`` and ``most``."""
    ws = r"[ \t\n\x{0b}\f\r]"
    ends = (r"\n(?:\n|\r\n)", r"\n", rf"[.!?]{ws}", "[。！？]", rf"(?:[;:,]{ws}|[；：，、])", ws)
    upto = [f"length(regexp_extract(left(rest, {most}), '(?s)^.*{e}'))" for e in ends]
    return f"CASE WHEN length(rest) <= {most} THEN length(rest) " + " ".join(f"WHEN {n} >= {least} THEN {n}" for n in upto) + f" ELSE {most} END"


_PIECES = f"""WITH RECURSIVE l AS (SELECT max_size AS m, overlap_size AS o FROM size_limits WHERE limit_name = 'claim_chunk'),
t AS (SELECT DISTINCT table_name, record_id, text FROM (SELECT 'source_sections' AS table_name, section_id AS record_id, text FROM source_sections UNION ALL SELECT 'extraction_requests', request_id, section_text FROM extraction_requests), l WHERE length(text) > m),
c AS (SELECT table_name, record_id, text, -1 AS n, CAST(0 AS BIGINT) AS begun, CAST(0 AS BIGINT) AS size FROM t
  UNION ALL SELECT table_name, record_id, text, n + 1, begun + size, CASE WHEN n < 0 THEN {_cut('m', 'greatest(o, m // 2, 1)')} ELSE {_cut('(m - o)', 'least(m - o, greatest(o, (m - o) // 2, 1))')} END
  FROM (SELECT *, substr(text, begun + size + 1) AS rest FROM c), l WHERE rest <> '') """

#: Documents, every window of so many characters by its hash, and the runs of windows that another document has.
_SPANS = f"""WITH w AS (SELECT doc_id, i, md5_number(substr(text, i + 1, {spans.SPAN})) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - {spans.SPAN - 1})) AS i FROM documents)),
s AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id))),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {spans.SPAN} THEN 0 ELSE 1 END AS new FROM s),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
f AS (SELECT doc_id, min(i) AS span_start, max(i) + {spans.SPAN} AS span_end FROM k GROUP BY doc_id, k) """

SQL = {
    "p10_found": _SPANS + "SELECT * FROM f",
    "p10_shares": _SPANS + "SELECT doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(x, 0) AS BIGINT) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(x, 0) / length(text) ELSE 0.0 END AS shared_share FROM documents LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS x FROM f GROUP BY 1) USING (doc_id)",
    "p5_forms": _FORMS + "SELECT table_name, record_id, form FROM f",
    "p5_classes": _FORMS + "SELECT table_name, record_id, sha256(form) AS class_id FROM d QUALIFY min(text) OVER (PARTITION BY table_name, form) <> max(text) OVER (PARTITION BY table_name, form)",
    "p5_found": _FORMS + "SELECT DISTINCT a.table_name, a.record_id AS record_a, b.record_id AS record_b FROM d a JOIN d b ON a.table_name = b.table_name AND a.form = b.form AND a.text <> b.text AND a.record_id < b.record_id",
    "p6_found": _COPIES + ", g AS (SELECT table_name, id, min(id) OVER (PARTITION BY table_name, q, f) AS a FROM k) SELECT table_name, a AS record_a, id AS record_b FROM g WHERE id <> a",
    "p6_records": _COPIES + "SELECT table_name, min(id) AS record_id, count(*) AS n_copies FROM k GROUP BY table_name, q, f",
    "p7_pieces": _PIECES + "SELECT table_name, record_id, n AS piece_no, CAST(count(*) OVER (PARTITION BY table_name, record_id) AS INT) AS n_pieces, CAST(begun - CASE WHEN n > 0 THEN o ELSE 0 END AS INT) AS start, substr(text, begun - CASE WHEN n > 0 THEN o ELSE 0 END + 1, size + CASE WHEN n > 0 THEN o ELSE 0 END) AS piece FROM c, l WHERE n >= 0",
    "p7_found": "WITH l AS (SELECT max_size FROM size_limits WHERE limit_name = 'claim_chunk') SELECT DISTINCT 'source_sections' AS table_name, section_id AS record_id FROM source_sections, l WHERE length(text) > max_size UNION SELECT DISTINCT 'extraction_requests', request_id FROM extraction_requests, l WHERE length(section_text) > max_size",
}
