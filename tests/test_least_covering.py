"""The least claim that covers an annotation: all ways of counting against all pairs, and many that share their words."""

import random
import time

import numpy as np
import pytest

from claimloom.operators import containment, evaluation

POOL = ["after", "storage", "sample", "release", "polymer", "carrier", "dose", "water", "film", "gel"]


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_postings_against_all_pairs(few, monkeypatch):
    monkeypatch.setattr(containment, "FEW", few)
    rng = random.Random(few)
    for n in (1, 64, 150):
        has = [{w for w in range(12) if rng.random() < (0.02 if w < 5 else 0.6)} for _ in range(n)]
        pairs = sorted((i, w) for i, x in enumerate(has) for w in x)
        some = containment._Postings(np.array([w for _, w in pairs], np.int64), np.array([i for i, _ in pairs], np.int64), 13, n)
        for _ in range(300):
            words, need = [rng.randrange(13) for _ in range(rng.randint(1, 8))], rng.randint(1, 6)
            want = next((i for i, x in enumerate(has) if sum(w in x for w in words) >= need), n)
            assert some.least(np.array(words), need) == want


@pytest.mark.parametrize("block", ["one", "many"])
def test_blocks_against_all_pairs(spark, block, monkeypatch):
    if block == "many":
        monkeypatch.setattr(containment, "ASKED", 7)
        monkeypatch.setattr(containment, "BITS", 9)
    rng = random.Random(1)
    a = [(i, rng.choices([*POOL, "nowhere", "42.1"], k=rng.randint(0, 7))) for i in range(40)]
    a = [(i, w, rng.randint(1, 5)) for i, w in a]
    c = [(f"c{i}", " ".join(rng.choices([*POOL, "after,", "hydrogels", "642.17"], k=rng.randint(0, 6)))) for i in rng.sample(range(1000), 60)] + [("c", None), (None, " ".join(POOL))]
    got = {tuple(r) for r in containment.least_covering(spark.createDataFrame(a, "id bigint, words array<string>, need int"), spark.createDataFrame(c, "id string, text string")).collect()}
    found = {(i, min((k for k, t in c if k and sum(x in (t or "") for x in w) >= need), default=None)) for i, w, need in a if w}
    assert got == {x for x in found if x[1]} and got


def test_quotes_of_short_words(spark):
    a = spark.createDataFrame([("1", "a b"), ("2", "A b "), ("3", "zz"), ("4", " "), ("5", None), ("6", "film a b")], "annotation_id string, source_quote string")
    c = spark.createDataFrame([("y", "xa by"), ("x", "film xA B"), ("w", "a  b"), (None, "a b")], "claim_id string, source_quote string")
    assert {tuple(r) for r in evaluation.best_matches(a, c).collect()} == {("1", "x"), ("2", "x"), ("6", "x")}


def test_many_with_the_same_words(spark):
    """Each annotation shares many words with all claims: pairs of both are 144 million, matches few."""
    n, rng = 12_000, random.Random(2)
    a = [(f"a{i:05}", f"{' '.join(POOL)} no{i:05}") for i in range(n)]
    c = [(f"c{i:05}", " ".join(rng.sample(POOL, 7)) + (f" no{i:05}" if i % 100 == 0 else "")) for i in range(n)]
    a, c = (spark.createDataFrame(x, f"{k} string, source_quote string") for x, k in ((a, "annotation_id"), (c, "claim_id")))
    began = time.monotonic()
    got = evaluation.best_matches(a, c).collect()
    assert {tuple(r) for r in got} == {(f"a{i:05}", f"c{i:05}") for i in range(0, n, 100)}
    assert time.monotonic() - began < 60


def many(spark, n):
    """Annotations and claims with the columns of an evaluation; all pairs share many words, each hundredth annotation has its claim."""
    rng = random.Random(2)
    a = [(f"a{i:05}", f"{' '.join(POOL)} no{i:05}", "t", "may", None, i % 200 == 0) for i in range(n)]
    c = [(f"c{i:05}", " ".join(rng.sample(POOL, 7)) + (f" no{i:05}" if i % 100 == 0 else ""), "t", 1, None, "it may be" if i % 400 == 0 else "is", None) for i in range(n)]
    same = "claim_type string, {}author_hedging string, {}scope_description string"
    return spark.createDataFrame(a, f"annotation_id string, source_quote string, {same.format('', '')}, must_extract boolean"), spark.createDataFrame(c, f"claim_id string, source_quote string, {same.format('page int, ', 'faithful_paraphrase string, ')}")


def test_metrics_of_many(spark):
    a, c = many(spark, 12_000)
    began = time.monotonic()
    got = evaluation.metrics(a, c, evaluation.best_matches(a, c)).first().asDict()
    assert time.monotonic() - began < 60
    assert got == dict(positives=60, negatives=11_940, recall_n=60, negative_n=60, quote_d=60, quote_n=60, locator_n=60, type_d=60, type_n=60, hedging_d=60, hedging_n=30, scope_d=0, scope_n=0)


def test_trimmed_is_strip(spark):
    from pyspark.sql import functions as F

    from claimloom.functions import text

    texts = [None, "", " ", "a", " a b\t", "　a", "a ", "\x1c\x85", "​a", "é ", "采 用"] + [chr(c) + "x" + chr(d) for c, d in ((0x1680, 0x61), (0x62, 0x205F), (0x0E, 0x21), (0xA0, 0x2000), (0x200A, 0x202F), (0x180E, 0xFEFF))]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert df.where(~text.trimmed("x").eqNullSafe(text.strip("x"))).count() == 0
    assert df.select(F.count_if(text.strip("x") != F.col("x"))).first()[0] == 10


def test_gate_of_many(spark):
    a, c = many(spark, 12_000)
    began = time.monotonic()
    left = evaluation.unsupported(a, c)
    counts = evaluation.metrics(a, c, evaluation.best_matches(a, c))
    got = {r.metric: (r.value, r.passed) for r in evaluation.gate(counts, left.selectExpr("count(*) AS n")).collect()}
    assert time.monotonic() - began < 60
    assert got["unsupported_accepted"] == (12_000.0, False) and got["recall"] == (100.0, True) and got["hedging_preservation"] == (50.0, False) and got["negative_extraction"] == (0.5, False)
