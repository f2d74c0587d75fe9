import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from claimloom.llm import dupes

FIELDS = ["q", "p"]
SCHEMA = "id string, q string, p string, h bigint, digest string"


def plain(s):
    if s is None:
        return None
    kept = [c for i, c in enumerate(s) if not unicodedata.category(c).startswith("P") or (0 < i < len(s) - 1 and s[i - 1] in "0123456789" and s[i + 1] in "0123456789")]
    return re.sub(r"\s", "", "".join(kept)).lower()


def test_canonical(spark):
    texts = ["A b,c.", "1,234.5", "1, 234", "1..2", "1.2.3", ".5", "5.", "（中文）。", "", " \t ", None, "«É»", "x" * 100_000 + "!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(dupes.canonical(F.col("t"))).collect()] == [plain(t) for t in texts]


def groups(rows):
    found = {}
    for i, q, p, *_ in rows:
        if i is not None:
            found.setdefault((plain(q), plain(p)), set()).add(i)
    return found


def test_copies_against_grouping(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        x = 0 if i % 3 == 0 else rng.randrange(2500)  # one group holds a third
        q = "".join(rng.choice([c.upper(), c, c + " ", c + "."]) for c in f"abc{x}".replace("1", "z"))
        rows.append((f"I{i:05d}", q, rng.choice(["P", "p "]), 1, "x"))
    rows += rng.sample(rows, 200) + [("n1", None, None, 1, "x"), ("n2", None, None, 1, "x"), ("n3", "", None, 1, "x"), (None, "a", "b", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    keyed = dupes.keyed(df, "t", "id", FIELDS)
    got = {(r.record_a, r.record_b) for r in dupes.copies(keyed, len(rows)).collect()}
    want = groups(rows)
    assert got == {(min(m), x) for m in want.values() for x in m if x != min(m)}
    flat = dupes.collapsed(keyed, len(rows)).collect()
    assert {(r.record_id, r.n_copies) for r in flat} == {(min(m), len(m)) for m in want.values()} and len(flat) == len(want)


def test_filter_passes_every_repeat_and_few_others(spark):
    rows = spark.range(0, 40_000).select((F.col("id") % 30_000).alias("x")).select(F.xxhash64("x").alias("h"), "x").repartition(6)
    got = dupes.possible_repeats(rows, dupes.filter_words(40_000)).groupBy("repeats", (F.col("x") < 10_000).alias("twice")).count().collect()
    n = {(r.repeats, r.twice): r["count"] for r in got}
    assert n[(True, True)] == 20_000 and (False, True) not in n and n.get((True, False), 0) < 2000


def test_small_filters_stay_exact(spark):
    rows = [(f"I{i}", f"t{i % 900}", "p", 1, "x") for i in range(1000)]
    keyed = dupes.keyed(spark.createDataFrame(rows, SCHEMA), "t", "id", FIELDS)
    assert dupes.copies(keyed, 0).count() == 100


def test_payloads(spark):
    o = {"source_quote": "qé", "faithful_paraphrase": "p", "more": 1}
    raws = [json.dumps(o), json.dumps({"claims": [o]}, ensure_ascii=False), json.dumps({"claims": []}), json.dumps({"claims": [o, o]}), json.dumps(o)[:-9], "", None, json.dumps({"source_quote": "only"})]
    got = {r.raw_id: (r.source_quote, r.faithful_paraphrase) for r in dupes.claims_of_payloads(spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "raw_id string, payload string")).collect()}
    assert got == {"0": ("qé", "p"), "1": ("qé", "p"), "7": ("only", None)}


def test_empty(spark):
    keyed = dupes.keyed(spark.createDataFrame([], SCHEMA), "t", "id", FIELDS)
    assert dupes.copies(keyed, 0).count() == 0 and dupes.collapsed(keyed, 0).count() == 0
