from collections import defaultdict

import numpy as np

from claimloom.llm import pack


def run(spark, sizes, limits, **kw):
    counts = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(None, 5, "x")], "doc_id bigint, n_tokens bigint, part string")
    return pack.packing(counts, spark.createDataFrame(limits, "limit_name string, max_size int"), **kw).collect()


def check(rows, sizes, limits):
    for name, capacity in limits:
        own = [r for r in rows if r.limit_name == name]
        load, parts = defaultdict(int), defaultdict(list)
        for r in own:
            load[r.container_id] += r.n_tokens
            parts[r.doc_id].append((r.part, r.n_tokens))
        assert max(load.values(), default=0) <= capacity
        assert {d: sum(n for _, n in p) for d, p in parts.items()} == {i: n or 0 for i, n in enumerate(sizes)}
        for d, p in parts.items():
            n = sizes[d] or 0
            assert sorted(x for x, _ in p) == list(range(len(p))) and len(p) == max(1, -(-n // capacity))
            assert len(p) == 1 or n > capacity
        yield sum(load.values()) / (len(load) * capacity) if load else 1.0


def test_all_fit(spark):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.lognormal(5, 1, 1500)] + [0, 512, 1024, 50_000, None]
    limits = [("a", 512), ("b", 2048)]
    fills = list(check(run(spark, sizes, limits, shard=400), sizes, limits))
    assert min(fills) > 0.95


def test_equal_and_empty(spark):
    limits = [("a", 10)]
    assert list(check(run(spark, [6] * 300, limits, shard=50), [6] * 300, limits)) == [0.6]
    assert list(check(run(spark, [5] * 300, limits, shard=50), [5] * 300, limits))[0] > 0.95
    assert run(spark, [], limits) == [] and run(spark, [5], []) == []
    assert list(check(run(spark, [0, 0, None], limits), [0, 0, None], limits)) == [0.0]


def whole(packing, sizes, capacity):
    groups, rooms = packing
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert rooms == [capacity - sum(sizes[i] for i in g) for g in groups] and min(rooms) >= 0 and all(groups)


def test_crossover_and_mutation_keep_items_and_capacity():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 400, 300).tolist())
    a, b = (pack.greedy(sizes, 512, rng.choice(300, 100, replace=False).tolist()) for _ in range(2))
    for _ in range(20):
        a, b = pack.crossover(a, b, sizes, 512, rng), pack.mutated(a, sizes, 512, rng)
        whole(a, sizes, 512)
        whole(b, sizes, 512)


def triplets(n):
    """Sizes of which exactly three fill a container, so that n containers hold them all."""
    rng = np.random.default_rng(5)
    a = rng.integers(380, 491, n)
    b = rng.integers(250, (1000 - a) // 2 + 1)
    return sorted(np.r_[a, b, 1000 - a - b].tolist())


def test_evolution_gains_much_on_triplets():
    sizes = triplets(600)
    alone = len(pack.greedy(sizes, 1000)[0])
    best = pack.evolve(sizes, 1000, 1, [])
    whole(best, sizes, 1000)
    assert alone > 690 and 600 <= len(best[0]) < 620


def test_islands_gain_on_triplets(spark):
    sizes = triplets(200)
    counts = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    limits = spark.createDataFrame([("t", 1000)], "limit_name string, max_size int")
    got = pack.fill(counts, limits).first()
    assert 200 <= got.containers < 210 and got.best_fit_containers > 225 and got.n_tokens == 200_000
    rows = pack.packing(counts, limits).collect()
    assert len({r.container_id for r in rows}) == got.containers
    list(check(rows, sizes, [("t", 1000)]))


def test_lower_bound():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bound = pack.least_containers(sizes, 100)
        assert -(-int(sizes.sum()) // 100) <= bound <= len(pack.greedy(sizes.tolist(), 100)[0])
    assert pack.least_containers(np.array([51] * 7), 100) == 7 and pack.least_containers(np.array([], int), 9) == 0
