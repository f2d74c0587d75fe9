"""Matches by substrings against all pairs of the given tables, by the reference's rules."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from claimloom import plans
from claimloom.functions.text import DASHES
from claimloom.operators import containment, evaluation, segments
from tests.conftest import DATA


def records(duck, table, record_id):
    got = duck.execute(f"SELECT * FROM {table} WHERE {record_id} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {record_id} ORDER BY received_at) = 1")
    names = [d[0] for d in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def rows(name, spark):
    return {tuple(r) for r in plans.queries()[name](spark, str(DATA)).collect()}


def test_substrings(spark):
    w = spark.createDataFrame([("ab",), ("abcdefgh",), ("cdefghi",), ("x",), ("zz",)], "word string")
    t = spark.createDataFrame([("abcdefghi",), ("xab",), ("abcdefg",), ("z",)], "token string")
    assert {tuple(r) for r in containment.substrings(w, t).collect()} == {(a.word, b.token) for a in w.collect() for b in t.collect() if a.word in b.token}


def emitted(quote, text):
    words = [w for w in (quote or "").lower().split() if len(w) > 3]
    n = sum(w in text.lower() for w in words)
    return len(text.strip()) >= 20 and len(words) >= 2 and n >= (len(words) * 0.5 if len(words) <= 5 else max(len(words) * 0.45, 3))


def test_provider_emits_all_pairs(spark, duck):
    want = {(c["claim_id"], r["request_id"]) for c in records(duck, "source_claims", "claim_id") for r in records(duck, "extraction_requests", "request_id") if emitted(c["source_quote"], r["section_text"] or "")}
    assert want and rows("txt5_provider", spark) == want


def best_match(quote, claims):
    target = (quote or "").strip().lower()
    words = [w for w in target.split() if len(w) > 2]
    for c in claims:
        text = (c["source_quote"] or "").lower().strip()
        if target and (target in text or words and sum(w in text for w in words) / len(words) >= 0.7):
            return c["claim_id"]


def split(duck):
    claims = sorted(records(duck, "source_claims", "claim_id"), key=lambda c: c["claim_id"])
    of = lambda *s: [c for c in claims if c["record_review_status"] in s]
    return of("pending"), of("rejected"), of("approved", "approved_with_edits")


def test_best_matches(spark, duck):
    positive, negative, claims = split(duck)
    found = ((a["claim_id"], best_match(a["source_quote"], claims)) for a in positive + negative)
    want = {x for x in found if x[1]}
    assert want and rows("evl1_best_match", spark) == want


@pytest.mark.parametrize("quote, text, hit", [("melted", "it melted, then", True), ("采用分步退火", "采用分步退火制备", True), ("a b", "xa by", True), ("a b", "a c b", False), ("aaa aaa bbb", "aaa", False), ("bbb aaa aaa aaa", "aaa", True)])
def test_best_match_of_one(spark, quote, text, hit):
    a, c = spark.createDataFrame([("A", quote)], "annotation_id string, source_quote string"), spark.createDataFrame([("C", text), ("D", "other")], "claim_id string, source_quote string")
    assert [tuple(r) for r in evaluation.best_matches(a, c).collect()] == ([("A", "C")] if hit else [])


def test_unsupported(spark):
    a = spark.createDataFrame([("A", "b c", False), ("B", " good ", True), ("C", " ", False)], "annotation_id string, source_quote string, must_extract boolean")
    c = spark.createDataFrame([("1", "ab cd"), ("2", "good"), ("3", "new"), ("4", ""), ("5", "b x c")], "claim_id string, source_quote string")
    assert {r.claim_id for r in evaluation.unsupported(a, c).collect()} == {"3", "5"}


def test_whole_quotes_against_all_pairs(spark):
    texts = [("1", "the quick brown fox"), ("2", "a quick  brown foxes jump"), ("3", "quick\nbrown fox"), ("4", ""), ("5", None), ("6", "采用分步退火制备 的"), ("7", "x"), ("8", "over the lazy dog and the quick brown fox again")]
    quotes = ["quick brown fox", "the quick brown fox", "ick brown fo", "brown", "row", "退火", " ", "", None, "x", "quick  brown foxes", "lazy dog and the qu", "nowhere to be found", "the the the"]
    t = spark.createDataFrame([(q, q) for q in quotes], "id string, quote string")
    got = {tuple(r) for r in containment.whole_in(t, spark.createDataFrame(texts, "id string, text string")).collect()}
    assert got == {(q, i) for q in quotes for i, x in texts if q and q.strip() and x and q in x}
    assert containment.whole_in(t.limit(0), spark.createDataFrame(texts, "id string, text string")).count() == 0


def test_labels_in_any_section(spark, duck):
    source = {c["claim_id"]: c["source_id"] for c in records(duck, "source_claims", "claim_id")}
    texts = [(s["source_id"], (s["text"] or "").lower()) for s in records(duck, "source_sections", "section_id")]
    found = lambda s, l: s is not None and any(l.lower() in t for x, t in texts if x == s)
    want = [(at["locator_id"], l, found(source.get(at["claim_id"]), l)) for at in records(duck, "claim_locators", "locator_id") for l in (at["figure_label"], at["table_label"]) if l is not None]
    got = [tuple(r) for r in plans.queries()["join16_labels"](spark, str(DATA)).collect()]
    assert want and sorted(got) == sorted(want)


@pytest.mark.parametrize("text, quote, at", [("a b c", "b c", 2), ("x\n𝛥 b\nc d", " 𝛥b c", 2), ("ab", "c", -1), ("", "c", -1), (None, "c", -1), ("  ", " \t", 2)])
def test_place(spark, text, quote, at):
    df = spark.createDataFrame([(text, quote)], "t string, q string")
    assert df.select(segments.place(F.col("t"), F.col("q"))).first()[0] == at


def test_buckets_over_the_whole_source(spark, duck):
    claims, located = records(duck, "source_claims", "claim_id"), {}
    for at in sorted(records(duck, "claim_locators", "locator_id"), key=lambda x: x["locator_id"]):
        located.setdefault(at["claim_id"], at)
    sections = records(duck, "source_sections", "section_id")
    norm = lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFC", x)).translate({ord(d): "-" for d in DASHES}).strip()
    got = {r.claim_id: r for r in plans.queries()["txt2_buckets"](spark, str(DATA)).collect()}
    assert len(got) == len(claims)
    seen = set()
    for c in claims:
        pages = sorted((s for s in sections if s["source_id"] == c["source_id"]), key=lambda s: (s["sequence_number"], s["section_id"]))
        texts, at, r = "\n".join(s["text"] or "" for s in pages).lower(), located.get(c["claim_id"], {}), got[c["claim_id"]]
        words = norm(c["source_quote"] or "").split()
        if r.match_status in ("ambiguous", "not_found"):
            share = sum(w.lower() in norm(texts) for w in words) / max(len(words), 1)
            assert r.match_status == ("ambiguous" if len(words) >= 5 and share > 0.8 else "not_found")
        errors = [f"Page {r.page} does not exist"] if r.page is not None and not any(s["page_start"] <= r.page <= (s["page_end"] or s["page_start"]) for s in pages if s["page_start"] is not None) else []
        errors += [f"{w} '{at[f]}' not in source" for w, f in (("Figure", "figure_label"), ("Table", "table_label")) if at.get(f) and at[f].lower() not in texts]
        assert r.locator_errors == "; ".join(errors) and (r.page is None) == (at.get("page") is None)
        seen.add(r.match_status)
    assert "ambiguous" in seen


def test_padded_heading(spark):
    pages = spark.createDataFrame([("S", 1, " " * 90 + "Discussion\nx")], "source_id string, page int, text string")
    assert [r.section_type for r in segments.sections(pages).collect()] == ["discussion"]
