from pathlib import Path

import pytest

from claimloom.llm import tokens

if not Path(tokens.TOKENIZER).exists():
    pytest.skip("no tokenizer here", allow_module_level=True)


def test_counts_are_exact(spark):
    texts = ["", None, "Hello world", "溶解度 <|endoftext|>", "x" * 300_000, "é\x00\n"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in tokens.token_counts(df, "text").collect()}
    own = tokens.tokenizer(tokens.TOKENIZER)
    assert got == {i: len(own.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert tokens.token_counts(df.limit(0), "text").count() == 0


def test_languages(spark):
    cases = {"EN": "en", "en-GB": "en", " English": "en", "zh_Hans": "zh", "中文": "zh", "CN": "zh", "de-AT": "de", "und": "unknown", "": "unknown", None: "unknown", "xx": "unknown", "fra": "fr"}
    cases |= {"es": "es", "JA": "ja", "pt-BR": "pt", "sr_Latn_RS": "sr", "spa": "spa", "und-Latn": "unknown", "n/a": "unknown", "unknown": "unknown", "?": "unknown", "42": "unknown", "e": "unknown", " ko ": "ko"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r[0]: r[1] for r in df.select("x", tokens.language(df.x)).collect()} == cases


def test_budget(spark):
    sections = spark.createDataFrame([("A", "S1", "one two", "d"), ("A", "S1", "one two", "d"), ("B", "S1", "three", "d"), ("C", None, "four", "d"), ("D", "S9", None, "d")], "section_id string, source_id string, text string, domain string")
    sources = spark.createDataFrame([("S1", "EN", "chem"), ("S1", "EN", "chem"), ("S2", "de", None)], "source_id string, language string, subject_domain string")
    documents = spark.createDataFrame([(1, "Hub ", "eng", None, "one"), (2, "hub", None, "chem", ""), (3, None, "zh", "chem", "two")], "doc_id bigint, source string, lang string, domain string, text string")
    rows = tokens.token_budget(sections, sources, documents).collect()
    n = {(r.table_name, r.level, r.source, r.language, r.domain): (r.n_records, r.n_tokens) for r in rows}
    assert len(n) == len(rows)
    count = lambda t: len(tokens.tokenizer(tokens.TOKENIZER).encode_ordinary(t))
    assert n[("source_sections", 7, None, None, None)] == (4, count("one two") + count("three") + count("four"))
    assert n[("source_sections", 3, "S1", None, None)] == (2, count("one two") + count("three"))
    assert n[("source_sections", 5, None, "unknown", None)][0] == 2
    assert n[("documents", 3, "hub", None, None)] == (2, count("one"))
    assert n[("documents", 0, "hub", "en", "unknown")] == (1, count("one"))
    assert tokens.token_budget(sections.limit(0), sources.limit(0), documents.limit(0)).count() == 0
