import random

import pytest

from claimloom.llm import spans
from tests.conftest import DATA


def brute(docs):
    seen = {}
    for i, t in docs:
        for p in range(len(t or "") - spans.SPAN + 1):
            seen.setdefault(t[p : p + spans.SPAN], set()).add(i)
    out = set()
    for i, t in docs:
        run = None
        for p in range(len(t or "") - spans.SPAN + 1):
            if len(seen[t[p : p + spans.SPAN]]) > 1:
                if run and p <= run[1]:
                    run[1] = p + spans.SPAN
                else:
                    out |= {(i, *run)} if run else set()
                    run = [p, p + spans.SPAN]
        out |= {(i, *run)} if run else set()
    return out


def found(spark, docs, n=3):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "id bigint, text string, doc int, start int").repartition(n)
    return {tuple(r) for r in spans.shared_spans(df, "id", "text").collect()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé溶😀 ") for _ in range(rng.randint(3, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    notice, base = text(60), [text(rng.randint(5, 300)) for _ in range(12)]
    docs = []
    for _ in range(60):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            b = rng.choice([notice, *base])
            a = rng.randrange(len(b))
            t += b[a : a + rng.choice([150, 199, 200, 201, 260, 5000])] + text(rng.randint(0, 20))
        docs.append(t)
    docs += [notice] * 15 + [text(3) + notice + text(3) for _ in range(15)]
    docs += ["-" * 450, "-" * 450 + "x", "ab" * 300, "", None, "short", base[0] + base[0]]
    return list(enumerate(docs))


def test_against_brute_force(spark):
    docs = corpus(1)
    assert found(spark, docs) == brute(docs)


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(spans, "MOST_OPEN", 0)
    docs = corpus(2)
    assert found(spark, docs) == brute(docs)


def test_long_text(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefghij ") for _ in range(spans.SLICE + 50_000))
    cut = [(5, long), (6, "x" * 37 + long[300_000:300_700]), (7, long[spans.SLICE - 400 : spans.SLICE + 400] + "y")]
    assert found(spark, cut, 2) == {(5, 300_000, 300_700), (5, spans.SLICE - 400, spans.SLICE + 400), (6, 37, 737), (7, 0, 800)}


def test_within_one_record_only(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdefghij ") for _ in range(400))
    assert found(spark, [(1, t + t), (2, "other")]) == set()
    assert found(spark, []) == set()


def test_shares(spark):
    t = "".join(random.Random(3).choice("abcdefghij ") for _ in range(300))
    df = spark.createDataFrame([(1, t), (2, "zz" + t), (3, None), (4, "")], "id bigint, text string")
    got = {r.doc_id: (r.n_chars, r.shared_chars, round(r.shared_share, 3)) for r in spans.shared_shares(df, "id", "text", spans.shared_spans(df, "id", "text")).collect()}
    assert got == {1: (300, 300, 1.0), 2: (302, 300, 0.993), 3: (0, 0, 0.0), 4: (0, 0, 0.0)}


def test_comparing_in_parts_changes_nothing(monkeypatch):
    import pyarrow as pa

    rng = random.Random(11)
    rows = sorted((rng.randrange(12), rng.randrange(5), rng.randrange(3), [rng.randrange(4) for _ in range(rng.randint(1, 5))]) for _ in range(200))
    t = pa.table(
        {
            "run": pa.array(range(200), pa.int64()), "at": pa.array([r[2] for r in rows], pa.int32()), "h": pa.array([r[0] for r in rows], pa.int64()),
            "least": pa.array([r[1] for r in rows], pa.int64()), "most": pa.array([r[1] for r in rows], pa.int64()), "hot": pa.array([False] * 200), "stretches": pa.array([r[3] for r in rows], pa.list_(pa.int64())),
        }
    )
    found = lambda: sorted(tuple(x.values()) for b in spans._compare(iter(t.to_batches(max_chunksize=7))) for x in b.to_pylist())
    together = found()
    monkeypatch.setattr(spans, "TOGETHER", 10)
    assert found() == together and together


def test_without_broadcasts(spark):
    """Beyond Spark's broadcast threshold the seeds are shuffled; the result is the same."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = corpus(5)
        assert found(spark, docs) == brute(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_repeated_anchors_are_those_of_several_texts(spark):
    docs = [(1, "ab" * 300), (2, corpus(6)[3][1]), (3, None), (4, "")]
    anchors = lambda d: spans.repeated_anchors(spans.seeds(spark.createDataFrame(d, "id bigint, text string"), "id", "text")).count()
    assert anchors(docs) == 0 and anchors([*docs, (5, "ab" * 200)]) > 0


def test_long_runs_of_one_character(spark):
    """A text of one character has a seed at every place, all of one run, which is compared once."""
    rng = random.Random(8)
    other = "".join(rng.choice("abcdefghij ") for _ in range(300))
    docs = [(1, "a" * 20_000), (2, other + "a" * 150 + other[::-1]), (3, "x" + "a" * 230 + "y"), (4, "-" * 5_000 + other), (5, "-" * 120 + "."), (6, "ab" * 4_000), (7, "b" + "ab" * 102 + "c")]
    assert found(spark, docs) == brute(docs)
    made = spans.seeds(spark.createDataFrame(docs, "id bigint, text string"), "id", "text")
    assert made.where("doc = 1").count() == 19_801 and made.where("doc = 1").select("h", "run").distinct().count() == 1


def test_given_documents(spark):
    if not DATA.exists():
        pytest.skip("no test data here")
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in df.collect()]
    assert {tuple(r) for r in spans.shared_spans(df, "doc_id", "text").collect()} == brute(docs)
