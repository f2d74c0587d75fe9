"""Filling containers with a grouping genetic algorithm on islands.

Items are dealt by hash to shards of bounded size, which are packed independently; several islands
evolve packings of each shard from different seeds, pass their best to the next island, and evolve on,
several times over.

Crossover takes the containers of both parents whole, fullest first, and drops those that hold an item
already placed. The items so left over (displaced) are first exchanged against one or two of the items of
containers with room, where that fills them better, and what remains is put in by best fit, largest first.
Mutation empties some containers, the emptiest and others, and places their items in the same way. Fewer
containers win, and of as many those that leave their room in one place.

A text is divided only if it alone exceeds the container: into full containers and one rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.durable import written

#: Items of a shard on average, islands of a shard, packings of an island, times that islands evolve, generations of each time at most, and without gain.
SHARD, ISLANDS, POPULATION, EPOCHS, GENERATIONS, PATIENCE = 2000, 2, 4, 3, 30, 3
#: Rounds of an exchange, loose items that are tried in twos, and the share of containers with room that mutation empties.
ROUNDS, PAIRED, EMPTIED = 3, 100, 0.1

#: A packing: the items of each container, and the room left in each.
Packing = tuple[list[list[int]], list[int]]


def least_containers(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound: by the sum of all sizes, and by items over half of the capacity, no two of which go together."""
    s = np.sort(sizes[sizes > 0])[::-1].astype(np.int64)
    if not len(s):
        return 0
    sums = np.r_[0, np.cumsum(s)]
    k = np.unique(np.r_[0, s[2 * s <= capacity]])  # the least size that is counted beside the large ones
    alone = np.searchsorted(-s, -(capacity - k), "left")  # larger than what leaves room for k
    large = int(np.searchsorted(-s, -capacity / 2, "left"))
    counted = np.searchsorted(-s, -k, "right")
    room = (large - alone) * capacity - (sums[large] - sums[alone])
    more = np.maximum(0, -(-(sums[np.maximum(counted, large)] - sums[large] - room) // capacity))
    return int(max(-(-int(s.sum()) // capacity), (large + more).max()))


def best_fit(items: list[int], sizes: list[int], packing: Packing, capacity: int) -> None:
    """Put items, largest first, into the fullest container that takes them, opening new ones; changes the packing."""
    groups, rooms = packing
    free = sorted((r, b) for b, r in enumerate(rooms) if r > 0)
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            left, b = free.pop(at)
            groups[b].append(i)
        else:
            left, b = capacity, len(groups)
            groups.append([i])
            rooms.append(capacity)
        rooms[b] = left - size
        if left > size:
            insort(free, (left - size, b))


def exchange(loose: list[int], sizes: list[int], packing: Packing, rng: np.random.Generator) -> list[int]:
    """Swap one or two items of containers with room for one or two loose ones that fill them best; returns the items then loose.

    In each round the best swap of every container is found at once, by search among the sums of the loose
    items; a loose item goes to the container that gains most by it.
    """
    groups, rooms = packing
    for _ in range(ROUNDS):
        if not loose:
            break
        at, first, second = _sets(groups, rooms, rng)
        size = np.array([*sizes, 0], np.int64)  # the last stands for no item
        base = size[first] + size[second]
        room = np.array(rooms, np.int64)[at]
        free = np.array(loose)
        i, j = np.triu_indices(min(len(free), PAIRED), 1)
        some = rng.permutation(len(free))  # of many loose items only some are paired
        one, two = np.r_[free, free[some[i]]], np.r_[np.full(len(free), len(sizes)), free[some[j]]]
        order = np.argsort(size[one] + size[two], kind="stable")
        one, two, sums = one[order], two[order], (size[one] + size[two])[order]
        k = np.searchsorted(sums, base + room, "right") - 1
        gain = np.where(k >= 0, sums[np.maximum(k, 0)] - base, 0)
        changed, gone = set(), set()
        best = np.argsort(rng.random(len(gain)) * 1e-6 - gain / np.maximum(room, 1), kind="stable")
        best = best[np.sort(np.unique(at[best], return_index=True)[1])]  # the best of each container, in their order
        for c in best[gain[best] > 0].tolist():
            b, into = int(at[c]), {int(one[k[c]]), int(two[k[c]])} - {len(sizes)}
            if b in changed or into & gone:
                continue
            out = {int(first[c]), int(second[c])} - {-1}
            groups[b] = [x for x in groups[b] if x not in out] + sorted(into)
            rooms[b] -= int(gain[c])
            changed.add(b)
            gone |= into
            loose = loose + sorted(out)
        if not changed:
            break
        loose = [x for x in loose if x not in gone]
    return loose


def _sets(groups: list[list[int]], rooms: list[int], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Containers with room and up to three of their items, alone (the second is then -1) or in twos."""
    at, first, second = [], [], []
    for b, room in enumerate(rooms):
        if room > 0:
            group = groups[b]
            if len(group) > 3:
                group = [group[x] for x in rng.integers(0, len(group), 3)]
                group = list(dict.fromkeys(group))
            for x, i in enumerate(group):
                for j in (-1, *group[:x]):
                    at.append(b)
                    first.append(i)
                    second.append(j)
    return np.array(at, np.int64), np.array(first, np.int64), np.array(second, np.int64)


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Greater is better: fewer containers, then room that is gathered in few of them."""
    rooms = np.asarray(packing[1])
    return -len(rooms), float(((1 - rooms / capacity) ** 2).mean()) if len(rooms) else 0.0


def _placed(packing: Packing, loose: list[int], sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    best_fit(exchange(loose, sizes, packing, rng), sizes, packing, capacity)
    return packing


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """The containers of both parents, fullest first, as far as they hold no item twice; the rest placed anew."""
    pool = [(r, k, g) for (groups, rooms), luck in ((a, rng.random(len(a[0]))), (b, rng.random(len(b[0])))) for r, k, g in zip(rooms, luck.tolist(), groups, strict=True)]
    used = bytearray(len(sizes))
    groups, rooms = [], []
    for room, _, group in sorted(pool, key=lambda x: x[:2]):
        if not any(used[i] for i in group):
            groups.append(list(group))
            rooms.append(room)
            for i in group:
                used[i] = 1
    return _placed((groups, rooms), [i for i in range(len(sizes)) if not used[i]], sizes, capacity, rng)


def mutated(a: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with its emptiest containers and as many others emptied, and their items placed anew."""
    groups, rooms = a
    n = min(len(groups), max(2, int(sum(r > 0 for r in rooms) * EMPTIED)))
    gone = {*sorted(range(len(rooms)), key=lambda b: -rooms[b])[: n // 2 + 1], *rng.choice(len(groups), n, replace=False).tolist()}
    kept = [list(g) for b, g in enumerate(groups) if b not in gone], [r for b, r in enumerate(rooms) if b not in gone]
    return _placed(kept, [i for b in gone for i in groups[b]], sizes, capacity, rng)


def greedy(sizes: list[int], capacity: int, first: list[int] | None = None) -> Packing:
    """Best fit of all items, of some before the others."""
    packing: Packing = ([], [])
    early = set(first or ())
    best_fit(list(early), sizes, packing, capacity)
    best_fit([i for i in range(len(sizes)) if i not in early], sizes, packing, capacity)
    return packing


def evolve(sizes: list[int], capacity: int, seed: int, given: list[Packing], generations: int = GENERATIONS, patience: int = PATIENCE) -> Packing:
    """The best packing after generations from the given ones and perturbed best-fit packings.

    It ends where the lower bound is met, after ``generations``, or after ``patience`` of them without gain.
    """
    rng = np.random.default_rng(seed)
    bound = least_containers(np.array(sizes, np.int64), capacity)
    population = list(given)
    while len(population) < POPULATION and not any(len(p[0]) <= max(1, bound) for p in population):
        early = np.flatnonzero(rng.random(len(sizes)) < 0.3).tolist() if population else None
        population.append(greedy(sizes, capacity, early))
    worth = [fitness(p, capacity) for p in population]
    stale = 0
    for _ in range(generations):
        best = max(range(len(worth)), key=worth.__getitem__)
        if -worth[best][0] <= max(1, bound) or stale >= patience:
            break
        before = worth[best]
        x, y = rng.choice(len(population), 2, replace=False).tolist()
        pairs = ((best, x if x != best else y), (x, y))
        for make in (*(lambda a=a, b=b: crossover(population[a], population[b], sizes, capacity, rng) for a, b in pairs), lambda: mutated(population[max(range(len(worth)), key=worth.__getitem__)], sizes, capacity, rng)):
            child = make()
            value, worst = fitness(child, capacity), min(range(len(worth)), key=worth.__getitem__)
            if value > worth[worst]:
                population[worst], worth[worst] = child, value
        stale = 0 if max(worth) > before else stale + 1
    return population[max(range(len(worth)), key=worth.__getitem__)]


def _numbers(packing: Packing, n: int) -> np.ndarray:
    """The container of each item."""
    bins = np.zeros(n, np.int32)
    for b, group in enumerate(packing[0]):
        bins[group] = b
    return bins


def _packing(bins: np.ndarray, sizes: list[int], capacity: int) -> Packing:
    groups: list[list[int]] = [[] for _ in range(int(bins.max()) + 1)]
    for i, b in enumerate(bins.tolist()):
        groups[b].append(i)
    return groups, [capacity - sum(sizes[i] for i in g) for g in groups]


_STATE = "limit_name string, capacity int, shard bigint, island int, items array<struct<n_tokens:bigint,doc_id:bigint,part:bigint>>, bins array<int>, containers int, score double, best_fit int"


def _epoch(number: int):
    """A partition function: shards with islands in, each island's best packing out; packings that came along take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bins, values, plain = [], [], []
            lists, given = b.column("items"), b.column("given")
            for r, (capacity, shard, island, known) in enumerate(zip(*(b.column(c).to_pylist() for c in ("capacity", "shard", "island", "best_fit")), strict=True)):
                sizes = lists[r].values.field("n_tokens").to_pylist()
                packings = [_packing(np.array(g, np.int32), sizes, capacity) for g in given[r].as_py()]
                if known is None:
                    packings = [greedy(sizes, capacity)]
                    known = len(packings[0][0])
                best = evolve(sizes, capacity, (shard * 1_000_003 + island * 101 + number) & 0xFFFFFFFF, packings)
                bins.append(_numbers(best, len(sizes)))
                values.append(fitness(best, capacity))
                plain.append(known)
            kept = ["limit_name", "capacity", "shard", "island", "items"]
            made = [pa.array(bins, pa.list_(pa.int32())), pa.array([-n for n, _ in values], pa.int32()), pa.array([s for _, s in values], pa.float64()), pa.array(plain, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], [*kept, "bins", "containers", "score", "best_fit"])

    return run


def _dealt(counts: DataFrame, limits: DataFrame, shard: int, islands: int, epochs: int) -> tuple[DataFrame, DataFrame]:
    """The best packing of every shard, and the containers that parts of divided documents fill alone."""
    spark = counts.sparkSession
    sized = counts.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    capacities = [(r.limit_name, r.max_size) for r in limits.select("limit_name", "max_size").where("max_size > 0").collect()]  # fixed rows
    shards = max(1, round(sized.count() / shard))
    sizes = F.array(*(F.struct(F.lit(name).alias("limit_name"), F.lit(size).alias("capacity")) for name, size in capacities)) if capacities else F.array().cast("array<struct<limit_name:string,capacity:int>>")
    each = sized.withColumn("l", F.explode(sizes)).select("l.*", "doc_id", "n_tokens")
    full = F.floor(F.col("n_tokens") / F.col("capacity"))
    whole = each.where("n_tokens >= capacity").select("limit_name", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("part"), "doc_id", F.col("capacity").cast("bigint").alias("n_tokens"))
    whole = whole.select("limit_name", F.concat_ws("-", F.lit("full"), "doc_id", "part").alias("container_id"), "doc_id", "part", "n_tokens")
    rest = each.where("n_tokens = 0 OR n_tokens % capacity > 0").select("limit_name", "capacity", "doc_id", full.alias("part"), (F.col("n_tokens") % F.col("capacity")).alias("n_tokens"))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "limit_name"), F.lit(shards)))
    items = dealt.groupBy("limit_name", "capacity", "shard").agg(F.sort_array(F.collect_list(F.struct("n_tokens", "doc_id", "part"))).alias("items"))
    # One task for a few shards at a time, however small their rows are.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(capacities) * shards * islands // 16)
    key = ["limit_name", "shard", "island"]
    state = items.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")).select("*", F.array().cast("array<array<int>>").alias("given"), F.lit(None).cast("int").alias("best_fit"))
    for number in range(epochs):
        state = written(state.repartition(tasks, *key).mapInArrow(_epoch(number), _STATE), "islands")
        if number + 1 < epochs:  # each island goes on with its own best and that of the island before it
            elites = state.select("limit_name", "shard", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("elite"))
            state = state.join(elites, key).select("limit_name", "capacity", "shard", "island", "items", F.array("bins", "elite").alias("given"), "best_fit")
    best = state.groupBy("limit_name", "shard").agg(F.max_by(F.struct("items", "bins", "containers", "best_fit"), F.struct(-F.col("containers"), F.col("score"), F.col("island"))).alias("best"))
    return best.select("limit_name", "shard", "best.*"), whole


def packing(counts: DataFrame, limits: DataFrame, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``limit_name, container_id, doc_id, part, n_tokens``: every document in containers of every limit.

    ``counts`` has ``doc_id, n_tokens``; ``limits`` a few fixed rows ``limit_name, max_size`` (positive).
    Parts of a divided document are numbered from 0, full ones first. A document without tokens is an item of
    size 0. Container ids are unique per limit. Documents without an id are left out.
    """
    best, whole = _dealt(counts, limits, shard, islands, epochs)
    rows = best.select("limit_name", "shard", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    return rows.select("limit_name", F.concat_ws("-", "shard", "x.bins").alias("container_id"), "x.items.doc_id", "x.items.part", "x.items.n_tokens").unionByName(whole)


def fill(counts: DataFrame, limits: DataFrame, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``limit_name, containers, best_fit_containers, n_tokens, fill``: how full the containers of each limit
    are, and how many best fit alone would have needed for the same shards."""
    best, whole = _dealt(counts, limits, shard, islands, epochs)
    tokens = F.aggregate("items", F.lit(0).cast("bigint"), lambda n, i: n + i["n_tokens"])
    parts = best.select("limit_name", "containers", "best_fit", tokens.alias("n_tokens")).unionByName(whole.select("limit_name", F.lit(1).alias("containers"), F.lit(1).alias("best_fit"), "n_tokens"))
    sums = parts.groupBy("limit_name").agg(F.sum("containers").alias("containers"), F.sum("best_fit").alias("best_fit_containers"), F.sum("n_tokens").alias("n_tokens"))
    return sums.join(limits.select("limit_name", "max_size"), "limit_name").select("limit_name", "containers", "best_fit_containers", "n_tokens", (F.col("n_tokens") / (F.col("containers") * F.col("max_size"))).alias("fill"))
