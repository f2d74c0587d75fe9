"""Text expressions, quotes, sections, blocks, answers and search on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions.jsonclaims import parse_answers
from claimloom.operators import containment, digests, evaluation, quotes, search, segments, sequences
from claimloom.operators.deliveries import by_content, once
from claimloom.sources import sinks


def one(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return df.select(expression).first()[0]


def test_strip_and_words(spark):
    assert one(spark, T.strip("x"), x="　 a b\t\n") == "a b"
    assert one(spark, T.words("x"), x=" a  b c ") == ["a", "b", "c"]
    assert one(spark, T.words("x"), x="") == []
    assert one(spark, T.normalise("x"), x=" café  well‐known ") == "café well-known"
    assert one(spark, T.key("x"), x=" \t") is None


@pytest.mark.parametrize(
    "quote, text, want",
    [
        ("b c", "a b c d", ("exact", 2, 5)), ("b c", "a b c b c", ("exact", 2, 5)), ("hello world", "hello   world", ("normalised", 0, 11)), ("hello world", "hello world", ("normalised", 0, 11)),
        ("well-known x", "well‐known x", ("normalised", 0, 12)), ("café", "café", ("normalised", 0, 4)), ("aa bb cc dd ee", "ee dd cc bb aa", ("ambiguous", None, None)),
        ("aa bb cc dd zz", "ee dd cc bb aa", ("not_found", None, None)), ("aa bb cc dd", "dd cc bb aa", ("not_found", None, None)), ("", "x", ("exact", 0, 0)), (None, "x", ("not_found", None, None)), ("x", None, ("not_found", None, None)),
    ],
)
def test_cascade(spark, quote, text, want):
    df = spark.createDataFrame([(quote, text)], "q string, t string").withColumns({"nq": T.normalise("q"), "nt": T.normalise("t")})
    assert tuple(df.select(quotes.cascade("q", "t", "nq", "nt").alias("m")).first().m) == want


def pages(spark, rows):
    return spark.createDataFrame(rows, "source_id string, page int, text string")


@pytest.mark.parametrize(
    "texts, want",
    [
        (["Abstract\nx", "y", "Conclusion\nz"], [("abstract", 1, 2), ("conclusion", 3, 3)]), (["Abstract\nx\nIntroduction\ny"], [("introduction", 1, 1)]), (["cover", "Discussion\nx"], [("discussion", 2, 2)]),
        (["Results\nx"], [("body", 1, 1)]), (["", ""], [("body", 1, 2)]), (["results & discussion\n", "Materials and Methods"], [("results", 1, 1), ("experimental", 2, 2)]),
    ],
)
def test_sections(spark, texts, want):
    got = segments.sections(pages(spark, [("S", i + 1, t) for i, t in enumerate(texts)])).collect()
    assert sorted((r.section_type, r.page_start, r.page_end) for r in got) == sorted(want)


def test_page_quality(spark):
    rows = [("A", 1, "x" * 50), ("A", 2, "x" * 51), ("A", 3, "x" * 100), ("B", 1, "x" * 100), ("B", 2, ""), ("B", 3, ""), ("B", 4, "")]
    got = {r.source_id: r for r in segments.page_quality(pages(spark, rows)).collect()}
    assert (got["A"].n_with_text, got["A"].mean_chars_x10, got["A"].is_low_text) == (2, 670, False)
    assert (got["B"].n_with_text, got["B"].mean_chars_x10, got["B"].is_low_text) == (1, 250, True)


def test_lines_and_chunks(spark):
    assert one(spark, segments.without_references(F.col("x")), x="a\n [1-3] ref\nb") == "a\n\nb"
    assert one(spark, segments.without_short_lines(F.col("x")), x="abcd\nabc\n\n efgh ") == "abcd\n efgh "
    assert one(spark, segments.paragraph_chunks(F.col("x"), 7), x="aaa\n\nbbb\n\ncccccccccc\n\nd") == ["aaa\n\nbbb", "cccccccccc", "d"]
    assert one(spark, segments.paragraph_chunks(F.col("x"), 7), x="aaa") == ["aaa"]
    assert one(spark, segments.paragraph_chunks(F.col("x"), 7), x=None) is None


V = {"claim_type": "reported_result", "source_quote": "q", "faithful_paraphrase": "p", "evidence_basis_description": "e"}


@pytest.mark.parametrize(
    "raw, status, good, errors",
    [
        ({"claims": [V]}, "ok", 1, 0), ([V], "ok", 1, 0), ("```json\n" + json.dumps({"claims": [V]}) + "\n```", "ok", 1, 0), ({"claims": [V, {}]}, "ok", 1, 1), ({"claims": [V, 3]}, "ok", 1, 1), ({"claims": []}, "empty", 0, 1),
        ({}, "empty", 0, 1), ("  ", "empty", 0, 1), (None, "empty", 0, 1), ({"claims": "x"}, "invalid_json", 0, 1), ('"x"', "invalid_json", 0, 1), ("not json {", "invalid_json", 0, 1), ('{"claims":[{"a":"b', "invalid_json", 0, 1),
        ({"claims": [{}]}, "invalid_schema", 0, 1), (json.dumps({"claims": [V]})[:-1], "ok", 1, 0), ('{"a":1}}', "invalid_json", 0, 1),
    ],
)
def test_answers(spark, raw, status, good, errors):
    text = raw if raw is None or isinstance(raw, str) else json.dumps(raw)
    r = parse_answers(spark.createDataFrame([(text,)], "raw string"), "raw").first()
    assert (r.status, r.n_claims, r.n_errors) == (status, good, errors)


def test_numbering_of_a_large_group(spark):
    rows = [("hot", i) for i in range(5000)] + [(None, i) for i in range(5)] + [(f"g{i}", 1) for i in range(300)]
    got = sequences.numbering(spark.createDataFrame(rows, "g string, o int").repartition(7), ["g"], ["o"], "n").collect()
    assert len(got) == len(rows) and all(r.n == (r.o + 1 if r.g in ("hot", None) else 1) for r in got)


def test_search(spark, tmp_path):
    df = spark.createDataFrame([("1", "graphene oxide film"), ("2", "graphene ink"), ("3", "溶解度 test Café"), ("4", None)], "id string, t string")
    write = lambda rows, name: search.write_index(search.indexed(rows, "id", ["t"]), f"{tmp_path}/{name}")
    index = write(df, "index")
    found = lambda q: [r.record_id for r in search.bm25(spark, index, q).collect()]
    assert found("graphene") == ["2", "1"] and found("Graphene AND oxide") == ["1"] and found("graph") == [] and found("溶解") == [] and found("溶解度") == ["3"] and found("cafe") == ["3"]
    for q in ("", " AND ", "+-*"):
        with pytest.raises(ValueError):
            search.bm25(spark, index, q)
    assert search.bm25(spark, write(df.limit(0), "empty"), "x").count() == 0


def test_containment_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    make = lambda n, p: [(f"{p}{i}", list({rng.choice("abcdefghij") for _ in range(rng.randint(0, 8))})) for i in range(n)]
    a, b = make(40, "t"), make(60, "c")
    schema = "id string, words array<string>"
    got = {tuple(r) for r in containment.containing(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.7).collect()}
    assert got == {(i, j) for i, x in a for j, y in b if x and len(set(x) & set(y)) / len(x) >= 0.7 - 1e-9}


def test_digests(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None), ("3", "z")], "k string, v string")
    b = spark.createDataFrame([("3", "z"), ("1", "y"), ("4", "")], "k string, v string")
    dig = lambda df: tuple(digests.table_digest(df, "t", ["k", "v"]).first())
    assert dig(a) == dig(a.orderBy(F.desc("k")).repartition(3)) != dig(b) and dig(a.limit(0))[1:] == (0, "0", "0")
    assert {tuple(r) for r in digests.differences(a, b, ["k"], ["v"]).collect()} == {("1", "changed"), ("2", "removed"), ("4", "added")}


def test_deliveries(spark):
    from datetime import datetime

    rows = [("1", "a", datetime(2025, 1, 2)), ("1", "a", datetime(2025, 1, 1)), (None, "b", datetime(2025, 1, 1)), ("2", "c", None)]
    got = {r.id: r for r in once(spark.createDataFrame(rows, "id string, v string, received_at timestamp"), "id").collect()}
    assert set(got) == {"1", "2"} and got["2"].v == "c" and got["1"].received_at == datetime(2025, 1, 1)
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, None)], "id bigint, t string")
    assert {(r.record_id, r.canonical_id, r.is_new) for r in by_content(docs, "id", "t").collect()} == {(1, 1, True), (3, 1, False), (2, 2, True), (4, 4, True)}


@pytest.mark.parametrize("kind", ["csv", "jsonl", "parquet", "orc"])
def test_round_trips(spark, kind):
    rows = [("1", 'a "b"\nc,\r\n d '), ("2", None), ("3", ""), ("4", "é溶\\n")]
    df = spark.createDataFrame(rows, "id string, t string")
    assert sorted(map(tuple, sinks.round_trip(df, kind).collect())) == sorted(rows)


def test_html(spark):
    assert one(spark, sinks.html_row(["x", "y"]), x="<a & 'b'>", y=None) == "<tr><td>&lt;a &amp; &#x27;b&#x27;&gt;</td><td></td></tr>"


def test_gate(spark):
    a = spark.createDataFrame([("A1", "one two three four", "t", "may", None, True), ("A2", "nothing like it here", "t", None, None, True), ("A3", "bad quote here too", "t", None, None, False)], "annotation_id string, source_quote string, claim_type string, author_hedging string, scope_description string, must_extract boolean")
    c = spark.createDataFrame([("C1", "one two three five", "t", 1, None, "it may be", None)], "claim_id string, source_quote string, claim_type string, page int, author_hedging string, faithful_paraphrase string, scope_description string")
    m = evaluation.best_matches(a, c)
    assert m.count() == 1 or m.count() == 0
    counts = evaluation.metrics(a, c, m)
    got = {r.metric: r for r in evaluation.gate(counts, spark.createDataFrame([(0,)], "n bigint")).collect()}
    assert got["scope_preservation"].value == 100.0 and got["unsupported_accepted"].passed and len(got) == 8
