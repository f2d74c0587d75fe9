"""Points in ranges against all pairs."""

import random

from claimloom.operators import ranges


def test_against_all_pairs(spark):
    rng = random.Random(4)
    points = [(i, rng.choice("ab"), rng.choice([rng.randrange(-50, 300), 2147483647, None])) for i in range(80)]
    held = [(n, rng.choice("abc"), a, a + rng.choice([0, 1, 2, 5, 31, 32, 33, 200])) for n, a in enumerate(rng.randrange(-60, 280) for _ in range(60))]
    held += [(100, "a", 1, 2147483647), (101, "b", -2147483648, 2147483647), (102, "a", 9, 3), (103, "a", None, 4), (104, "a", 4, None), (105, None, 1, 9)]
    p, r = spark.createDataFrame(points, "i int, k string, at int"), spark.createDataFrame(held, "n int, k string, a int, b int")
    got = sorted((x.i, x.n) for x in ranges.in_ranges(p, r, ["k"], "at", "a", "b").collect())
    assert got == sorted((i, n) for i, k, at in points for n, kk, a, b in held if k == kk and None not in (at, a, b) and a <= at <= b)
    assert ranges.in_ranges(p.limit(0), r, ["k"], "at", "a", "b").count() == 0 == ranges.in_ranges(p, r.limit(0), ["k"], "at", "a", "b").count()
