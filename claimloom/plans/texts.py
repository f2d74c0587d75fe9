"""Queries on texts: scalars, quotes, sections, blocks, JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions.durable import written
from claimloom.functions.jsonclaims import parse_answers
from claimloom.functions.parallel import spread
from claimloom.operators import containment, providers, quotes, ranges, segments, validation
from claimloom.operators.deliveries import once
from claimloom.operators.sequences import numbering
from claimloom.plans import sqltext as Q
from claimloom.sources.tables import table


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "source_claims"), "claim_id")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "source_sections"), "section_id")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Sections in their order stand for the pages of a source."""
    return _sections(spark, d).select("source_id", F.col("sequence_number").alias("page"), "text")


def str_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """STR-1, 2, 4, 5, 8, 9, 15: strip, collapse, fold dashes, lower, cut, count words."""
    c = table(spark, d, "source_claims").select("claim_id", "source_quote").distinct()
    q = F.col("source_quote")
    return c.select("claim_id", T.strip(q).alias("stripped"), T.collapse(q).alias("collapsed"), T.fold_dashes(q).alias("folded"), F.left(F.lower(q), F.lit(80)).alias("shown"), F.size(T.words(q)).alias("n_words"))


def str3_nfc(spark: SparkSession, d: str) -> DataFrame:
    """STR-3: Unicode composition of all section texts, shown by hash."""
    return _sections(spark, d).select("section_id", F.sha2(T.nfc("text"), 256).alias("nfc_sha256"), F.length(T.nfc("text")).alias("n_chars"))


def str6_find_slice(spark: SparkSession, d: str) -> DataFrame:
    """STR-6, STR-7: where the hedging word stands in the quote, and the text from there."""
    q, h = F.col("source_quote"), F.col("author_hedging")
    at = F.instr(F.lower(q), F.lower(h)) - 1
    rows = table(spark, d, "source_claims").where("author_hedging IS NOT NULL AND author_hedging <> ''").select("claim_id", q, h).distinct()
    return rows.select("claim_id", at.alias("at"), F.when(at >= 0, F.substring(q, at + 1, F.lit(20))).alias("part"))


def str10_block_text(spark: SparkSession, d: str) -> DataFrame:
    """STR-10, STR-11, FLT-7, TXT-4: cleaned blocks worth reading."""
    return segments.blocks(_sections(spark, d)).select("section_id", F.length("block").alias("n_chars"), F.sha2("block", 256).alias("block_sha256"))


def str12_headings(spark: SparkSession, d: str) -> DataFrame:
    """STR-12: heading lines of all sections by type."""
    lines = _sections(spark, d).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(segments.heading_type(T.strip("line")).alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n_lines"))


def str13_quote_context(spark: SparkSession, d: str) -> DataFrame:
    """STR-13: 240 characters either side of each locator's quote in its section, white space being free if need be; empty where it is not found."""
    c, s = _claims(spark, d).select("claim_id", "source_quote"), _sections(spark, d).select("section_id", "text")
    at = once(table(spark, d, "claim_locators"), "locator_id").select("locator_id", "claim_id", "section_id")
    rows = at.join(c, "claim_id", "left").join(s, "section_id", "left").withColumn("at", segments.place(F.col("text"), F.col("source_quote")))
    x = F.when(F.col("at") >= 0, segments.context(F.col("text"), F.col("at"), F.length("source_quote")))
    return rows.select("locator_id", x.alias("x")).select("locator_id", F.coalesce("x.before", F.lit("")).alias("before"), F.coalesce("x.after", F.lit("")).alias("after"))


def str14_html(spark: SparkSession, d: str) -> DataFrame:
    """STR-14, SNK-6: one escaped HTML row per claim."""
    from claimloom.sources.sinks import html_row

    return _claims(spark, d).select("claim_id", html_row(["claim_id", "source_quote", "author_hedging"]).alias("html"))


def str17_hedging(spark: SparkSession, d: str) -> DataFrame:
    """STR-17: quotes with a hedging word, as substrings."""
    from claimloom.operators.evaluation import has_hedging

    return _claims(spark, d).groupBy("claim_type").agg(F.count("*").alias("n"), F.count_if(has_hedging(F.col("faithful_paraphrase"))).alias("n_hedged"))


def txt1_quote_match(spark: SparkSession, d: str) -> DataFrame:
    """TXT-1, JOIN-14, MTH-1: the cascade of each claim against its located section."""
    at = once(table(spark, d, "claim_locators"), "locator_id").groupBy("claim_id").agg(F.min_by(F.struct("section_id", "page"), "locator_id").alias("l")).select("claim_id", "l.*")
    return quotes.located(_claims(spark, d), at, _sections(spark, d)).select("claim_id", "status", F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"))


def txt2_source_match(spark: SparkSession, d: str) -> DataFrame:
    """TXT-2, WIN-5: the first section of its source that has the quote."""
    return quotes.in_source(_claims(spark, d), _sections(spark, d))


def txt2_buckets(spark: SparkSession, d: str) -> DataFrame:
    """TXT-2, FLT-9, FLT-10, SET-6, JOIN-16: each claim validated, failed or invalid, with its messages, page and confidence.

    A quote that is not in its located section is looked for in the whole source, whose first section that
    has it then gives the page. Errors of the locator are recorded and do not reject; sections stand for pages.
    """
    c = written(quotes.with_normal(spread(_claims(spark, d)), "source_quote", "nq"), "claims")
    s = quotes.readied(_sections(spark, d).select("section_id", "source_id", "sequence_number", "page_start", "page_end", "text"))
    at = written(once(table(spark, d, "claim_locators"), "locator_id").groupBy("claim_id").agg(F.min_by(F.struct("section_id", "page", "figure_label", "table_label"), "locator_id").alias("l")).select("claim_id", "l.*"), "locators")
    first = written(quotes.located(c, at, s).select("claim_id", F.col("status").alias("first")), "first")
    rest = written(c.join(first.where("first NOT IN ('exact', 'normalised')").select("claim_id"), "claim_id"), "rest")
    hits = quotes.hits_in_source(rest, s).join(s.select("section_id", "page_start"), "section_id")
    anywhere = written(hits.groupBy("claim_id").agg(F.min("kind").alias("kind"), F.min_by("page_start", F.struct("sequence_number", "section_id")).alias("found_on")), "anywhere")
    partly = quotes.partly_in_source(rest.join(anywhere, "claim_id", "left_anti"), s).withColumn("partly", F.lit(True))
    status = F.when(F.col("first").isin("exact", "normalised"), F.col("first")).when(F.col("kind") == 0, "exact").when(F.col("kind") == 1, "normalised").when(F.col("partly"), "ambiguous").otherwise("not_found")
    placed = at.select("claim_id", F.col("page").alias("claimed"), "figure_label", "table_label")
    rows = c.join(first, "claim_id").join(anywhere, "claim_id", "left").join(partly, "claim_id", "left").join(placed, "claim_id", "left").withColumn("match_status", status)
    rows = written(rows.withColumn("page", F.when(F.col("claimed").isNotNull(), F.coalesce("found_on", "claimed"))).drop("nq"), "matched")
    pages, labels = _known_pages(rows, s), _known_labels(rows.select("source_id", F.explode(F.array("figure_label", "table_label")).alias("label")), s)
    rows = rows.join(pages.withColumn("page_there", F.lit(True)), ["source_id", "page"], "left")
    for f in ("figure_label", "table_label"):
        rows = rows.withColumn("l", F.lower(f)).join(labels.withColumn(f"{f}_there", F.lit(True)), ["source_id", "l"], "left").drop("l")
    wrong = [F.when(F.col("page").isNotNull() & F.col("page_there").isNull(), F.concat(F.lit("Page "), "page", F.lit(" does not exist")))]
    wrong += [F.when((F.col(f) != "") & F.col(f"{f}_there").isNull(), F.concat(F.lit(f"{w} '"), f, F.lit("' not in source"))) for w, f in (("Figure", "figure_label"), ("Table", "table_label"))]
    rows = rows.select("claim_id", "match_status", "page", F.array_join(F.array_compact(F.array(*wrong)), "; ").alias("locator_errors"), validation.schema_errors().alias("schema"), validation.leaks([*validation.REQUIRED, "scope_description", "author_hedging"]).alias("leak"))
    found = F.col("match_status").isin("exact", "normalised")
    bucket = F.when(F.size("schema") > 0, "invalid_schema").when(~found | (F.size("leak") > 0), "failed_locator").otherwise("validated")
    confidence = F.when(found & F.col("page").isNotNull(), F.when(F.col("match_status") == "exact", "high").otherwise("medium")).when(found, "low")
    errors = F.array_join(F.when(F.size("schema") > 0, F.col("schema")).when(~found, F.array(F.concat(F.lit("Quote: "), F.col("match_status")))).otherwise(F.col("leak")), "; ")
    return rows.select("claim_id", "match_status", bucket.alias("bucket"), confidence.alias("confidence"), errors.alias("errors"), "page", "locator_errors")


def _known_pages(asked: DataFrame, sections: DataFrame) -> DataFrame:
    """``source_id, page``: the pages asked for that a section of the source covers; without an end it is one page."""
    s = sections.select("source_id", "page_start", F.coalesce("page_end", "page_start").alias("page_last"))
    return ranges.in_ranges(asked.select("source_id", "page").distinct(), s, ["source_id"], "page", "page_start", "page_last").select("source_id", "page").distinct()


def _known_labels(asked: DataFrame, sections: DataFrame) -> DataFrame:
    """``source_id, l``: the labels asked for, in lower case, that stand in a section of the source.

    A source has few different labels; each is looked for once in each of its sections.
    """
    each = asked.select("source_id", F.lower("label").alias("l")).where("l <> ''").distinct()
    texts = sections.select("source_id", F.lower("text").alias("t"))
    return each.join(texts, "source_id").where(F.contains("t", F.col("l"))).select("source_id", "l").distinct()


def txt3_sections(spark: SparkSession, d: str) -> DataFrame:
    """WIN-1, TXT-3: sections as islands of pages after a heading."""
    return segments.sections(_pages(spark, d).where("source_id IS NOT NULL AND page IS NOT NULL").groupBy("source_id", "page").agg(F.min("text").alias("text")))


def txt3_numbered(spark: SparkSession, d: str) -> DataFrame:
    """WIN-2: sections of each source numbered in order of page and id."""
    s = _sections(spark, d).where("source_id IS NOT NULL").select("section_id", "source_id", F.coalesce("page_start", F.lit(2147483647)).alias("page"))
    return numbering(s, ["source_id"], ["page", "section_id"], "n").select("section_id", "source_id", "n")


def txt4_chunks(spark: SparkSession, d: str) -> DataFrame:
    """WIN-4: paragraphs packed to chunks of 3000 characters."""
    s = _sections(spark, d).where("text IS NOT NULL").select("section_id", F.posexplode(segments.paragraph_chunks(F.col("text"), 3000)).alias("n", "chunk"))
    return s.select("section_id", "n", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


def txt5_provider(spark: SparkSession, d: str) -> DataFrame:
    """TXT-5, MTH-1, ARR-2: every claim that a deterministic provider emits, with each request that it emits it for.

    Enough of the claim's words of over three characters stand in the request's text as substrings.
    """
    asked = once(table(spark, d, "extraction_requests"), "request_id").where(F.length(T.strip("section_text")) >= providers.TEXT_CHARS).select(F.col("request_id").alias("id"), F.lower("section_text").alias("text"))
    known = _claims(spark, d).select(F.col("claim_id").alias("id"), providers.long_words("source_quote").alias("words")).where(F.size("words") >= providers.FEWEST)
    known = written(spread(known).withColumn("need", providers.needed(F.size("words"))), "known")
    held = containment.holding(known.select(F.explode("words").alias("word")).distinct(), spread(asked), least=4)
    return containment.overlapping(known, written(held, "held")).select(F.col("target_id").alias("claim_id"), F.col("candidate_id").alias("request_id"))


def txt8_quote_dedup(spark: SparkSession, d: str) -> DataFrame:
    """WIN-3, TXT-8: the first claim of each stripped quote within a source; blank quotes are dropped."""
    c = _claims(spark, d).select("claim_id", "source_id", T.strip("source_quote").alias("quote")).where("quote <> ''")
    return c.groupBy("source_id", "quote").agg(F.min("claim_id").alias("claim_id"), F.count("*").alias("n_claims"))


def txt9_failures(spark: SparkSession, d: str) -> DataFrame:
    """TXT-9, AGG-11: blocks, and failed runs, per source that has any run."""
    runs = once(table(spark, d, "processing_runs"), "run_id").groupBy("source_id").agg(F.count("*").alias("n_runs"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    made = segments.blocks(_sections(spark, d)).groupBy("source_id").agg(F.count("*").alias("n_blocks"))
    return runs.where("source_id IS NOT NULL").join(made, "source_id", "left").select("source_id", "n_runs", "n_failed", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def agg7_page_quality(spark: SparkSession, d: str) -> DataFrame:
    """AGG-7: how much text the pages of each source hold."""
    return segments.page_quality(_pages(spark, d))


#: What the answers of this data always hold.
ANSWERED = ("claim_type", "source_quote", "faithful_paraphrase")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return parse_answers(table(spark, d, "raw_claim_records").select("raw_id", "payload").distinct(), "payload", ANSWERED, bare=True)


def jsn1_answers(spark: SparkSession, d: str) -> DataFrame:
    """JSN-1..3, STR-16, ARR-1: status of each answer, with the numbers of good claims and of errors."""
    return _answers(spark, d).select("raw_id", "status", "n_claims", "n_errors")


def jsn1_claims(spark: SparkSession, d: str) -> DataFrame:
    """JSN-1: the good claims of all answers."""
    return _answers(spark, d).select("raw_id", F.explode("claims").alias("c")).select("raw_id", *(F.col(f"c.{f}").alias(f) for f in ANSWERED))


QUERIES = {f.__name__: f for f in (str_normal_forms, str3_nfc, str6_find_slice, str10_block_text, str12_headings, str13_quote_context, str14_html, str17_hedging, txt1_quote_match, txt2_source_match, txt2_buckets, txt3_sections, txt3_numbered, txt4_chunks, txt5_provider, txt8_quote_dedup, txt9_failures, agg7_page_quality, jsn1_answers, jsn1_claims)}

_C, _S, _L, _R = Q.once("source_claims", "claim_id"), Q.once("source_sections", "section_id"), Q.once("claim_locators", "locator_id"), Q.once("processing_runs", "run_id")


def _words(x: str) -> str:
    return f"list_filter(string_split({Q.collapse(Q.strip(x))}, ' '), lambda w: length(w) > 0)"


_BLOCK = f"""array_to_string(list_filter(string_split(regexp_replace(text, '(?m)^{T.WS}*\\[[0-9]+(?:[0-9,\\-]|{T.WS})*\\].*$', '', 'g'), chr(10)), lambda l: length({Q.strip('l')}) > 3), chr(10))"""
_BLOCKS = f"b AS (SELECT * FROM (SELECT *, {_BLOCK} AS block FROM {_S} WHERE section_type <> 'references') WHERE length({Q.strip('block')}) >= 50)"
_FLAT = f"regexp_replace(lower({Q.strip('line')}), '{T.WS}*(&|{T.WS}and{T.WS}){T.WS}*', ' and ', 'g')"
_KIND = "CASE " + " ".join(f"WHEN {_FLAT} IN ({', '.join(repr(n) for n in names)}) THEN '{k}'" for k, names in segments.HEADINGS.items()) + " END"
_FIRST_LOCATOR = f"(SELECT claim_id, section_id, page FROM {_L} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY locator_id) = 1)"
_LOCATED = f"""m AS (SELECT c.claim_id, c.source_quote AS q, s.text AS t, {Q.normalise('c.source_quote')} AS nq, {Q.normalise('s.text')} AS nt FROM {_C} c LEFT JOIN {_FIRST_LOCATOR} l USING (claim_id) LEFT JOIN {_S} s ON s.section_id = l.section_id),
w AS (SELECT *, list_filter(string_split({Q.collapse('nq')}, ' '), lambda w: length(w) > 0) AS ws FROM m),
x AS (SELECT claim_id, q, nq, t, nt, CASE WHEN instr(t, q) > 0 THEN 'exact' WHEN instr(nt, nq) > 0 THEN 'normalised' WHEN len(ws) >= 5 AND len(list_filter(ws, lambda w: contains(lower(nt), lower(w)))) > 0.8 * len(ws) THEN 'ambiguous' ELSE 'not_found' END AS status FROM w)"""
_ANYWHERE = f"""sn AS (SELECT source_id, section_id, sequence_number, text AS t, {Q.normalise('text')} AS nt FROM {_S}),
cn AS (SELECT claim_id, source_id, source_quote AS q, {Q.normalise('source_quote')} AS nq FROM {_C}),
aw AS (SELECT claim_id, section_id, sequence_number, CASE WHEN contains(t, q) THEN 0 ELSE 1 END AS kind FROM cn JOIN sn USING (source_id) WHERE nq <> '' AND (contains(t, q) OR contains(nt, nq))
  QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY kind, sequence_number, section_id) = 1)"""
_LEAK_FIELDS = [*validation.REQUIRED, "scope_description", "author_hedging"]
_SCHEMA = "list_filter([" + ", ".join([*(f"CASE WHEN coalesce({f}, '') = '' THEN 'Missing required field: {f}' END" for f in validation.REQUIRED), f"CASE WHEN coalesce(claim_type, '') <> '' AND claim_type NOT IN ({', '.join(map(repr, validation.CLAIM_TYPES))}) THEN 'Invalid claim_type: ' || claim_type END"]) + "], lambda e: e IS NOT NULL)"
_LEAK = "list_filter([" + ", ".join(f"CASE WHEN contains(lower({f}), '{w}') THEN 'Forbidden reference ''{w}'' in field ''{f}''' END" for f in _LEAK_FIELDS for w in validation.FORBIDDEN) + "], lambda e: e IS NOT NULL)"
_TRIM = Q.strip("payload")
_CLOSED = f"{_TRIM} || repeat('}}', CAST(greatest(length(regexp_replace({_TRIM}, '[^{{]', '', 'g')) - length(regexp_replace({_TRIM}, '[^}}]', '', 'g')), 0) AS INT))"
_PARSED = f"""r AS (SELECT DISTINCT raw_id, payload FROM raw_claim_records), p AS (SELECT raw_id, coalesce(TRY_CAST({_TRIM} AS JSON), TRY_CAST({_CLOSED} AS JSON)) AS j FROM r),
l AS (SELECT raw_id, j, CASE WHEN json_exists(j, '$.claims') THEN CAST(j->'$.claims' AS JSON[]) ELSE [j] END AS cs FROM p),
o AS (SELECT *, list_filter(cs, lambda c: {' AND '.join(f"trim(coalesce(c->>'$.{f}', '')) <> ''" for f in ANSWERED)} AND c->>'$.claim_type' IN ({', '.join(map(repr, validation.CLAIM_TYPES))})) AS ok FROM l)"""

SQL = {
    "str_normal_forms": f"SELECT DISTINCT claim_id, {Q.strip('source_quote')} AS stripped, {Q.collapse('source_quote')} AS collapsed, translate(source_quote, '{T.DASHES}', '------') AS folded, left(lower(source_quote), 80) AS shown, len({_words('source_quote')}) AS n_words FROM source_claims",
    "str3_nfc": f"SELECT section_id, sha256(nfc_normalize(text)) AS nfc_sha256, length(nfc_normalize(text)) AS n_chars FROM {_S}",
    "str6_find_slice": "SELECT claim_id, at_ AS \"at\", CASE WHEN at_ >= 0 THEN substr(source_quote, at_ + 1, 20) END AS part FROM (SELECT DISTINCT claim_id, source_quote, author_hedging, instr(lower(source_quote), lower(author_hedging)) - 1 AS at_ FROM source_claims WHERE author_hedging <> '')",
    "str10_block_text": f"WITH {_BLOCKS} SELECT section_id, length(block) AS n_chars, sha256(block) AS block_sha256 FROM b",
    "str12_headings": f"SELECT kind, count(*) AS n_lines FROM (SELECT {_KIND} AS kind FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM {_S})) WHERE kind IS NOT NULL GROUP BY kind",
    "str13_quote_context": f"""WITH r AS (SELECT locator_id, text AS t, source_quote AS q FROM {_L} LEFT JOIN (SELECT claim_id, source_quote FROM {_C}) USING (claim_id) LEFT JOIN (SELECT section_id, text FROM {_S}) USING (section_id)),
        e AS (SELECT *, instr(t, q) AS p, instr(regexp_replace(t, '{T.WS}+', '', 'g'), regexp_replace(q, '{T.WS}+', '', 'g')) AS free FROM r),
        o AS (SELECT locator_id, t, q, CASE WHEN t <> '' AND q <> '' THEN CASE WHEN p > 0 THEN p - 1 WHEN free > 0 THEN
          coalesce(list_filter(range(1, length(t) + 1), lambda i: NOT regexp_full_match(regexp_extract_all(t, '(?s).')[i], '{T.WS}'))[free] - 1, length(t)) END END AS p FROM e)
        SELECT locator_id, coalesce({Q.strip('substr(t, greatest(p - 240, 0) + 1, p - greatest(p - 240, 0))')}, '') AS before, coalesce({Q.strip('substr(t, p + length(q) + 1, 240)')}, '') AS after FROM o""",
    "str14_html": "SELECT claim_id, '<tr>' || " + " || ".join("'<td>' || replace(replace(replace(replace(replace(coalesce(" + c + ", ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '</td>'" for c in ("claim_id", "source_quote", "author_hedging")) + f" || '</tr>' AS html FROM {_C}",
    "str17_hedging": f"SELECT claim_type, count(*) AS n, count(*) FILTER (WHERE {' OR '.join(f'contains(lower(faithful_paraphrase), {w!r})' for w in ('may', 'might', 'could', 'suggest', 'potential', 'possibly', 'likely', 'appears', 'indicate'))}) AS n_hedged FROM {_C} GROUP BY claim_type",
    "txt1_quote_match": f"WITH {_LOCATED} SELECT claim_id, status, CAST(CASE status WHEN 'exact' THEN instr(t, q) - 1 WHEN 'normalised' THEN instr(nt, nq) - 1 ELSE -1 END AS INT) AS start, CAST(CASE status WHEN 'exact' THEN instr(t, q) - 1 + length(q) WHEN 'normalised' THEN instr(nt, nq) - 1 + length(nq) ELSE -1 END AS INT) AS \"end\" FROM x",
    "txt2_source_match": f"WITH {_ANYWHERE} SELECT claim_id, section_id, sequence_number, CASE kind WHEN 0 THEN 'exact' ELSE 'normalised' END AS status FROM aw",
    "txt2_buckets": f"""WITH {_LOCATED}, {_ANYWHERE},
        fo AS (SELECT claim_id, page_start AS found_on FROM cn JOIN sn USING (source_id) JOIN (SELECT section_id, page_start FROM {_S}) USING (section_id) WHERE nq <> '' AND (contains(t, q) OR contains(nt, nq)) QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY sequence_number NULLS FIRST, section_id) = 1),
        st AS (SELECT source_id, lower(string_agg(nt, chr(10))) AS lt FROM sn GROUP BY 1), fl AS (SELECT claim_id, page, figure_label, table_label FROM {_L} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY locator_id) = 1),
        k AS (SELECT c.claim_id, c.source_id, x.status IN ('exact', 'normalised') AS here, CASE WHEN here THEN x.status WHEN aw.kind = 0 THEN 'exact' WHEN aw.kind = 1 THEN 'normalised'
          WHEN len(w.ws) >= 5 AND len(list_filter(w.ws, lambda v: contains(lt, lower(v)))) > 0.8 * len(w.ws) THEN 'ambiguous' ELSE 'not_found' END AS match_status,
          CASE WHEN fl.page IS NOT NULL THEN CASE WHEN here THEN fl.page ELSE coalesce(found_on, fl.page) END END AS page, figure_label, table_label, {_SCHEMA} AS se, {_LEAK} AS le
          FROM {_C} c JOIN x USING (claim_id) JOIN w USING (claim_id) LEFT JOIN aw USING (claim_id) LEFT JOIN fo USING (claim_id) LEFT JOIN st ON st.source_id = c.source_id LEFT JOIN fl ON fl.claim_id = c.claim_id),
        f AS (SELECT *, match_status IN ('exact', 'normalised') AS found, list_filter([
          CASE WHEN page IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_S} s WHERE s.source_id = k.source_id AND k.page BETWEEN s.page_start AND coalesce(s.page_end, s.page_start)) THEN 'Page ' || page || ' does not exist' END,
          CASE WHEN figure_label <> '' AND NOT EXISTS (SELECT 1 FROM {_S} s WHERE s.source_id = k.source_id AND contains(lower(s.text), lower(k.figure_label))) THEN 'Figure ''' || figure_label || ''' not in source' END,
          CASE WHEN table_label <> '' AND NOT EXISTS (SELECT 1 FROM {_S} s WHERE s.source_id = k.source_id AND contains(lower(s.text), lower(k.table_label))) THEN 'Table ''' || table_label || ''' not in source' END], lambda e: e IS NOT NULL) AS wrong FROM k)
        SELECT claim_id, match_status, CASE WHEN len(se) > 0 THEN 'invalid_schema' WHEN NOT found OR len(le) > 0 THEN 'failed_locator' ELSE 'validated' END AS bucket,
        CASE WHEN found AND page IS NOT NULL THEN CASE match_status WHEN 'exact' THEN 'high' ELSE 'medium' END WHEN found THEN 'low' END AS confidence,
        array_to_string(CASE WHEN len(se) > 0 THEN se WHEN NOT found THEN ['Quote: ' || match_status] ELSE le END, '; ') AS errors, page, array_to_string(wrong, '; ') AS locator_errors FROM f""",
    "txt3_sections": f"""WITH p AS (SELECT source_id, sequence_number AS page, min(text) AS text FROM {_S} WHERE source_id IS NOT NULL AND sequence_number IS NOT NULL GROUP BY 1, 2),
        l AS (SELECT source_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
        h AS (SELECT source_id, page, arg_max(kind, i) AS kind, arg_max(heading, i) AS heading FROM (SELECT source_id, page, i, {_KIND} AS kind, {Q.strip('line')} AS heading FROM l) WHERE kind IS NOT NULL GROUP BY 1, 2),
        j AS (SELECT p.*, h.kind, h.heading, count(h.kind) OVER (PARTITION BY p.source_id ORDER BY p.page) AS island FROM p LEFT JOIN h USING (source_id, page)),
        g AS (SELECT source_id, island, coalesce(arg_min(kind, page), 'body') AS section_type, min(page) AS page_start, max(page) AS page_end, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM j GROUP BY 1, 2)
        SELECT g.source_id, CASE WHEN island = 0 THEN 'body' ELSE section_type END AS section_type, h.heading, page_start, page_end, n_pages, n_chars FROM g LEFT JOIN h ON h.source_id = g.source_id AND h.page = g.page_start AND island > 0
        WHERE island > 0 OR NOT EXISTS (SELECT 1 FROM h x WHERE x.source_id = g.source_id)""",
    "txt3_numbered": f"SELECT section_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(page_start, 2147483647), section_id) AS n FROM {_S} WHERE source_id IS NOT NULL",
    "txt4_chunks": f"""WITH RECURSIVE s AS (SELECT section_id, text, string_split(text, chr(10) || chr(10)) AS ps FROM {_S} WHERE text IS NOT NULL),
        r AS (SELECT section_id, ps, 0 AS i, '' AS cur, 0 AS n, NULL::VARCHAR AS chunk FROM s WHERE length(text) > 3000
          UNION ALL SELECT section_id, ps, i + 1, CASE WHEN closes OR cur = '' THEN ps[i + 1] ELSE cur || chr(10) || chr(10) || ps[i + 1] END, n + CAST(closes AS INT), CASE WHEN closes THEN {Q.strip('cur')} END
          FROM (SELECT *, length(cur) + length(ps[i + 1]) > 3000 AND cur <> '' AS closes FROM r WHERE i < len(ps))),
        c AS (SELECT section_id, n - 1 AS n, chunk FROM r WHERE chunk IS NOT NULL UNION ALL SELECT section_id, n, {Q.strip('cur')} FROM r WHERE i = len(ps) AND {Q.strip('cur')} <> '' UNION ALL SELECT section_id, 0, text FROM s WHERE length(text) <= 3000)
        SELECT section_id, n, length(chunk) AS n_chars, sha256(chunk) AS chunk_sha256 FROM c""",
    "txt5_provider": f"""WITH k AS (SELECT claim_id, list_filter({_words('lower(source_quote)')}, lambda w: length(w) > 3) AS ws FROM {_C}),
        r AS (SELECT request_id, lower(section_text) AS t FROM {Q.once('extraction_requests', 'request_id')} WHERE length({Q.strip('section_text')}) >= 20),
        n AS (SELECT claim_id, request_id, len(ws) AS size, len(list_filter(ws, lambda w: contains(t, w))) AS n FROM k, r WHERE len(ws) >= 2)
        SELECT claim_id, request_id FROM n WHERE CASE WHEN size <= 5 THEN n >= size * 0.5 ELSE n >= greatest(size * 0.45, 3) END""",
    "txt8_quote_dedup": f"SELECT source_id, {Q.strip('source_quote')} AS quote, min(claim_id) AS claim_id, count(*) AS n_claims FROM {_C} WHERE {Q.strip('source_quote')} <> '' GROUP BY 1, 2",
    "txt9_failures": f"WITH {_BLOCKS}, r AS (SELECT source_id, count(*) AS n_runs, count(*) FILTER (WHERE status = 'failed') AS n_failed FROM {_R} WHERE source_id IS NOT NULL GROUP BY 1) SELECT source_id, n_runs, n_failed, (SELECT count(*) FROM b WHERE b.source_id = r.source_id) AS n_blocks FROM r",
    "agg7_page_quality": f"SELECT source_id, count(*) AS n_pages, count(*) FILTER (WHERE length(text) > 50) AS n_with_text, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(floor(sum(length(text)) * 10 / count(*)) AS BIGINT) AS mean_chars_x10, count(*) FILTER (WHERE length(text) > 50) / count(*) < 0.3 AS is_low_text FROM {_S} GROUP BY source_id",
    "jsn1_answers": f"""WITH {_PARSED} SELECT raw_id, CASE WHEN j IS NULL THEN 'invalid_json' WHEN len(cs) = 0 THEN 'empty' WHEN len(ok) > 0 THEN 'ok' ELSE 'invalid_schema' END AS status, CASE WHEN j IS NULL THEN 0 ELSE len(ok) END AS n_claims, CASE WHEN j IS NULL OR len(cs) = 0 THEN 1 ELSE len(cs) - len(ok) END AS n_errors FROM o""",
    "jsn1_claims": f"WITH {_PARSED} SELECT raw_id, {', '.join(f"c->>'$.{f}' AS {f}" for f in ANSWERED)} FROM (SELECT raw_id, unnest(ok) AS c FROM o)",
}
