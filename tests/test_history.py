"""Histories against a plain walk through each claim's revisions."""

import json
import random

from claimloom.operators import history

SCHEMA = "revision_id string, claim_id string, previous_content_json string, new_content_json string, created_at string, content string"


def content(x, rng=None):
    o = {"claim_type": x, "source_quote": f"é{x}", "faithful_paraphrase": None if x == "n" else "p", "evidence_basis_description": ""}
    items = list(o.items())
    if rng:
        rng.shuffle(items)
    return json.dumps(dict(items), ensure_ascii=bool(rng and rng.random() < 0.5), indent=rng.choice([None, 1]) if rng else None)


def at(minute):
    return f"2025-01-01T{minute // 60:02d}:{minute % 60:02d}:00.000000+00:00"


def test_random_histories(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for c in range(40):
        n = 400 if c == 0 else rng.randint(1, 8)  # one claim has most rows: several words and blocks
        now = rng.choice("abn")
        for i in range(n):
            old, now = now, rng.choice("aabn")
            row = (f"R{c}-{i}", f"C{c}", content(old, rng), content(now, rng), at(i), None)
            rows += [row] * rng.choice([1, 1, 2])
            if now != old:
                want.add((f"C{c}", i * 60_000_000 + 1735689600000000))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = history.claim_versions(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(r.claim_id, r.valid_from_us) for r in got if r.valid_from_us is not None} == want
    for c in range(40):
        own = sorted((r for r in got if r.claim_id == f"C{c}"), key=lambda r: r.valid_from_us or 0)
        assert own[0].valid_from_us is None and own[-1].valid_to_us is None
        assert all(a.valid_to_us == b.valid_from_us and a.content_key != b.content_key for a, b in zip(own, own[1:], strict=False))


def test_one_instant_is_one_change(spark):
    rows = [
        ("1", "C", content("a"), content("b"), at(1), "x"),
        ("2", "C", content("c"), content("a"), "2025-01-01 01:02:00+01:00", "x"),  # the same instant as the next
        ("3", "C", content("b"), content("c"), at(2), "x"),  # b -> c -> a
        ("4", "C", content("a"), content("a"), at(3), "x"),  # without effect
        ("5", "C", content("a"), "{cut", at(4), None),
        ("6", None, content("a"), content("b"), at(4), None),
        ("7", "C", content("a"), content("b"), "no time", None),
        ("8", "D", content("a"), content("a"), at(4), None),
        ("9", "C", content("b"), content("a"), at(5), None),  # a -> b -> a: back where it was
        ("10", "C", content("a"), content("b"), at(5), None),
        ("11", "E", content("b"), content("a"), at(1), None),  # the same before anything else is known
        ("12", "E", content("a"), content("b"), at(1), None),
        ("13", "E", content("b"), content("n"), at(2), None),
    ]
    got = history.claim_history(spark.createDataFrame(rows, SCHEMA)).collect()
    c = sorted((r.valid_from_us or 0, r.claim_type) for r in got if r.claim_id == "C")
    assert [t for _, t in c] == ["a", "b", "a"]
    assert [(r.valid_from_us, r.claim_type) for r in got if r.claim_id == "D"] == [(None, "a")]
    assert [t for _, t in sorted((r.valid_from_us or 0, r.claim_type) for r in got if r.claim_id == "E")] == ["b", "n"]


def test_empty(spark):
    assert history.claim_versions(spark.createDataFrame([], SCHEMA)).count() == 0
