import random

import numpy as np

from claimloom.llm import mix


def sums(lengths, free):
    found = {0}
    for size, n in zip(lengths, free, strict=True):
        found = {x + k * size for x in found for k in range(n + 1)}
    return found


def test_fit_against_all_subsets():
    rng = random.Random(1)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 6))))
        free = np.array([rng.randint(1, 4) for _ in lengths])
        budget = rng.randint(0, int((lengths * free).sum()) + 5)
        take = mix.fit(lengths, free, budget)
        got = int((lengths * take).sum())
        assert (take >= 0).all() and (take <= free).all() and got <= budget
        assert got == max(x for x in sums(lengths.tolist(), free.tolist()) if x <= budget)


def test_fit_is_exact_where_many_lengths_are_free():
    rng = np.random.default_rng(2)
    lengths = np.arange(20, 900)
    free = rng.integers(1, 50, len(lengths))
    for budget in (12_345, 1_000_003, 5_555_555):
        assert int((lengths * mix.fit(lengths, free, budget)).sum()) == budget


def test_fit_beyond_the_first_rest():
    """Few lengths, of which the first rest would leave a gap, and lengths with a common divisor."""
    for lengths, free in (([1000, 1501], [500, 1]), ([600, 1001, 1501], [400, 3, 2]), ([64, 96, 160], [5000, 3000, 700]), ([999, 1000], [300, 300])):
        x, n = np.array(lengths), np.array(free)
        reached = np.array([0])
        for size, k in zip(lengths, free, strict=True):
            reached = np.unique((reached[:, None] + size * np.arange(k + 1)).ravel())
        for budget in (50_001, 123_457, 200_301, 299_999):
            assert int((x * mix.fit(x, n, budget)).sum()) == reached[reached <= budget].max()


def test_fit_of_very_long_lengths():
    lengths, free = np.array([1, 50_000, 300_000]), np.array([40_000, 4, 2])
    for budget in (89_123, 250_001, 419_999, 739_999):
        best = max(w + min(40_000, budget - w) for x in range(5) for y in range(3) if (w := 50_000 * x + 300_000 * y) <= budget)
        assert int((lengths * mix.fit(lengths, free, budget)).sum()) == best


def run(spark, docs, targets, **kw):
    counts = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, times int")
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    drawn = mix.mixture(counts, wanted, **kw)
    return drawn.collect(), {r.source: r for r in mix.shares(drawn, counts, wanted).collect()}


def test_shares(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["Big", " big", "BIG "]) if i % 3 else "small", rng.randint(1, 800), 1) for i in range(3000)]
    docs += [(9001, "other", 10, 1), (9002, None, 10, 1), (9003, "big", 0, 1), (9004, "big", None, 1)]
    drawn, shares = run(spark, docs, [("big", 0.3, 1), ("Small ", 0.7, 3), ("none", 0.1, 2)])
    assert abs(shares["big"].actual_share - 0.3) < 0.001 and abs(shares["small"].actual_share - 0.7) < 0.001 and shares["none"].actual_share == 0
    assert len({r.doc_id for r in drawn}) == len(drawn) and all(1 <= r.times <= (1 if r.source == "big" else 3) for r in drawn)
    assert {r.source for r in drawn} == {"big", "small"}
    again, _ = run(spark, docs, [("big", 0.3, 1), ("Small ", 0.7, 3), ("none", 0.1, 2)])
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))
    other, _ = run(spark, docs, [("big", 0.3, 1), ("Small ", 0.7, 3), ("none", 0.1, 2)], seed=1)
    assert sorted(map(tuple, drawn)) != sorted(map(tuple, other))


def test_one_length_holds_all(spark, monkeypatch):
    monkeypatch.setattr(mix, "BUCKET", 100)
    docs = [(i, "a", 10, 1) for i in range(2000)] + [(10_000 + i, "b", 10, 1) for i in range(500)]
    drawn, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert shares["a"].drawn_tokens == shares["b"].drawn_tokens == 5000 and len(drawn) == 1000


def test_empty(spark):
    drawn, shares = run(spark, [], [("a", 0.5, 1)])
    assert drawn == [] and shares["a"].drawn_tokens == 0
    assert run(spark, [(1, "a", 5, 1)], [])[0] == []
