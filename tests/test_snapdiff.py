import random
from datetime import datetime, timedelta

from claimloom.operators.snapdiff import snapshot_changes

SCHEMA = "snapshot_id string, taken_at timestamp, claim_id string, source_id string, claim_type string, record_review_status string, quote_match_status string, author_hedging string, updated_at string, h string, i int"


def row(s, claim, source="S", status="pending", hedge=None, updated="2025-01-01T00:00:00Z"):
    return (f"N{9 - s}", datetime(2025, 1, 1) + timedelta(days=s), claim, source, "t", status, "exact", hedge, updated, "x", 1)


def run(spark, rows):
    return {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_random_snapshots(spark):
    rng = random.Random(2)
    held = [{f"C{c}": rng.choice("ab") for c in range(30) if rng.random() < 0.6} for _ in range(6)]
    rows = [row(s, c, v) for s, x in enumerate(held) for c, v in x.items() for _ in range(rng.choice([1, 1, 2]))]
    rng.shuffle(rows)
    want = set()
    for s in range(1, 6):
        old, new = held[s - 1], held[s]
        for c in old.keys() | new.keys():
            kind = "added" if c not in old else "removed" if c not in new else "changed" if old[c] != new[c] else None
            if kind:
                want.add((f"N{9 - s}", c, kind))
    assert run(spark, rows) == want


def test_what_counts(spark):
    rows = [
        row(0, "A", status="pending"), row(1, "A", status=" Pending\t", updated="2026-01-01T00:00:00Z"),  # no change
        row(0, "B", hedge=None), row(1, "B", hedge=""),  # NULL is a value
        row(0, "C"), row(1, "C", "S2", updated="2025-01-01T02:00:00+02:00"), row(1, "C", "S", updated="2025-01-01 00:00:01+00:00"),  # the later row holds
        row(0, "D"), row(1, "D", None), row(1, None), (None, *row(1, "E")[1:]), row(1, "F", updated=None),
    ]
    assert run(spark, rows) == {("N8", "B", "changed"), ("N8", "D", "changed"), ("N8", "F", "added")}


def test_empty_and_single(spark):
    assert run(spark, []) == set()
    assert run(spark, [row(0, "A")]) == set()
