"""The written index against scores by hand."""

import math

import pytest
from pyspark.sql import functions as F

from claimloom.operators import search


def by_hand(rows, query):
    docs = {i: t.lower().split() for i, t in rows}
    terms, n, mean = search.query_terms(query), len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, words in docs.items():
        if all(t in words for t in terms):
            score = 0.0
            for t in terms:
                df, tf = sum(t in d for d in docs.values()), words.count(t)
                score -= max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * len(words) / mean))
            out[i] = round(score, 9)
    return out


def test_index(spark, tmp_path):
    rows = [(str(i), " ".join(["alpha"] * (i % 4) + ["beta"] * (i % 3) + ["gamma", f"w{i}"])) for i in range(40)] + [("e", "")]
    df = spark.createDataFrame(rows + [("n", None)], "id string, t string")
    folder = search.write_index(search.indexed(df, "id", ["t"]), f"{tmp_path}/ix")
    rows.append(("n", ""))
    for query in ("alpha", "alpha beta", "GAMMA and w7", "nowhere", "beta nowhere"):
        got = {r.record_id: round(r.score, 9) for r in search.bm25(spark, folder, query, None).collect()}
        assert got == by_hand(rows, query), query
    best = [r.record_id for r in search.bm25(spark, folder, "alpha beta", 3).collect()]
    want = by_hand(rows, "alpha beta")
    assert best == sorted(want, key=lambda i: (want[i], i))[:3]
    with pytest.raises(ValueError):
        search.bm25(spark, folder, " and ?")


def test_a_query_reads_its_words_only(spark, tmp_path):
    df = spark.createDataFrame([("1", "alpha beta")], "id string, t string")
    folder = search.write_index(search.indexed(df, "id", ["t"]), f"{tmp_path}/ix")
    plan = search.bm25(spark, folder, "alpha beta")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "term#" in x)
    assert "In(term, [alpha,beta])" in scan and "PartitionFilters: []" not in scan, scan


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "id string, t string")
    folder = search.write_index(search.indexed(df, "id", ["t"]), f"{tmp_path}/ix")
    assert search.bm25(spark, folder, "alpha").count() == 0


@pytest.mark.parametrize("text, want", [("The quick-brown fox jumps", ["quickbrown", "fox"]), ("a bc (def)", ["def"]), ("", []), (None, None), ("This THAT from there", [])])
def test_probe_words(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(search.probe_words(F.col("t"))).first()[0] == want
