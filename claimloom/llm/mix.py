"""Mixing sources to target shares of all tokens, by fitting sums to budgets.

Documents are counted by exact token length. Each source's budget is met by whole repeats of the
source, then by the same fraction of every length, and the rest (a few times the longest length) by
dynamic programming over the lengths still free (a bounded knapsack), all on counts. Documents are then
picked per length by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions.durable import written
from claimloom.functions.text import strip

#: The rest that the dynamic programme fits at first, as a multiple of the longest length.
SLACK = 32
#: Documents of one source and length that one window sorts; larger groups are cut by hash.
BUCKET = 50_000


def name(x: str):
    """Repositories compare without case and surrounding white space; blank is NULL."""
    return F.nullif(F.lower(strip(x)), F.lit(""))


def fit(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (distinct, positive, at most ``free``) to take so that their sum comes as near
    to the budget from below as any choice can.

    The same fraction of every length is taken first, and the rest is fitted exactly. Mostly that meets the
    budget, or the greatest multiple of the lengths' common divisor within it, and then nothing can be
    nearer; if not, a larger rest is fitted, in the end the whole budget. Memory grows with the rest, which
    is large only where very few lengths are free.
    """
    if budget >= int((lengths * free).sum()):
        return free.copy()
    unit = int(np.gcd.reduce(lengths))
    sizes, most, slack = lengths // unit, budget // unit, SLACK
    while True:
        take = _in_proportion(sizes, free, most, slack)
        take += _knapsack(sizes, free - take, most - int((sizes * take).sum()))
        if int((sizes * take).sum()) == most or slack * int(sizes.max()) >= most:
            return take
        slack *= 8


def _in_proportion(lengths: np.ndarray, free: np.ndarray, budget: int, slack: int) -> np.ndarray:
    """The same fraction of every length, so that a few times the longest are left of the budget."""
    longest = int(lengths.max())
    take = (free.astype(object) * max(0, budget - slack * longest) // int((lengths * free).sum())).astype(np.int64)
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths):  # one more of the long ones until the rest is a few of the longest
        if rest <= slack * longest:
            break
        more = min(int(free[i] - take[i]), (rest - slack // 2 * longest) // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    return take


def _knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """A bounded knapsack over all sums up to the budget: the choice whose sum is nearest."""
    take = np.zeros(len(lengths), np.int64)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    made_by = np.full(budget + 1, -1, np.int32)  # the step that first made each sum
    steps: list[tuple[int, int]] = []  # index of the length, and how many of it
    for i in np.argsort(lengths):
        n, size, chunk = int(min(free[i], budget // lengths[i])), int(lengths[i]), 1
        while n > 0 and not reach[budget]:
            k = min(chunk, n)
            new = reach[: budget + 1 - k * size] & ~reach[k * size :]
            if new.any():
                made_by[k * size :][new] = len(steps)
                reach[k * size :] |= new
                steps.append((int(i), k))
            n, chunk = n - k, 2 * chunk
    s = int(np.flatnonzero(reach)[-1])
    while s:
        i, k = steps[made_by[s]]
        take[i] += k
        s -= k * int(lengths[i])
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's counts by length in, what to take of each length out."""
    lengths, free = rows["n_tokens"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total, budget = int((lengths * free).sum()), int(rows["budget"].iloc[0])
    whole = min(budget // total, int(rows["max_repeats"].iloc[0])) if total else 0
    extra = fit(lengths, free, budget - whole * total) if whole < int(rows["max_repeats"].iloc[0]) else np.zeros(len(rows), np.int64)
    return pd.DataFrame({"source": rows["source"], "n_tokens": lengths, "n": free, "whole": whole, "extra": extra})


def mixture(counts: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, n_tokens, times`` of the documents drawn.

    ``counts`` has ``doc_id, source, n_tokens``; ``targets`` a few fixed rows ``source, target_share,
    max_repeats``. The total is the largest at which every source can give its share with at most
    max_repeats uses of each document; a source without tokens gives none and sets no limit. Sources not
    named, documents without tokens, and targets of no share or no repeats are left out.
    """
    wanted = targets.select(name("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    docs = counts.select("doc_id", name("source").alias("source"), "n_tokens").where("n_tokens > 0").join(F.broadcast(wanted), "source")  # a few fixed rows
    histogram = written(docs.groupBy("source", "target_share", "max_repeats", "n_tokens").agg(F.count("*").alias("n")), "lengths")
    sums = histogram.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("total"), F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"))
    most = sums.agg(F.min(F.col("total") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0.0
    budgets = histogram.withColumn("budget", F.floor(F.lit(float(most)) * F.col("target_share") + 1e-6))
    tasks = 4 * max(1, sums.count())  # as many as there are targets, a few fixed rows: not put together again
    plan = written(budgets.repartition(tasks, "source").groupBy("source").applyInPandas(_fit_source, "source string, n_tokens bigint, n bigint, whole bigint, extra bigint"), "plan")
    # A hash of the seed puts the documents of each length in order; those of a large group lie in several buckets.
    order = F.xxhash64(F.lit(seed), "doc_id")
    placed = docs.select("doc_id", "source", "n_tokens", order.alias("o")).join(plan, ["source", "n_tokens"])
    placed = placed.withColumn("bucket", F.pmod(F.shiftright("o", 32), F.ceil(F.col("n") / BUCKET)))
    group = ["source", "n_tokens", "bucket"]
    sizes = placed.where(F.col("n") > BUCKET).groupBy(*group).agg(F.count("*").alias("size"))
    before = sizes.select(*group, (F.sum("size").over(W.partitionBy("source", "n_tokens").orderBy("bucket")) - F.col("size")).alias("before"))
    ranked = placed.join(before, group, "left").withColumn("nth", F.row_number().over(W.partitionBy(*group).orderBy("o", "doc_id")) + F.coalesce("before", F.lit(0)))
    times = F.col("whole") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)
    return ranked.select("doc_id", "source", "n_tokens", times.cast("int").alias("times")).where("times > 0")


def shares(drawn: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: ``source, target_share, available_tokens, drawn_tokens, documents, most_repeats, actual_share``."""
    wanted = targets.select(name("source").alias("source"), "target_share")
    had = counts.groupBy(name("source").alias("source")).agg(F.sum("n_tokens").alias("available_tokens"))
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("drawn_tokens"), F.count("*").alias("documents"), F.max("times").alias("most_repeats"))
    rows = wanted.join(had, "source", "left").join(got, "source", "left")
    total = F.sum("drawn_tokens").over(W.partitionBy())  # as many rows as targets
    return rows.withColumn("actual_share", F.coalesce(F.try_divide("drawn_tokens", total), F.lit(0.0))).fillna(0, ["available_tokens", "drawn_tokens", "documents", "most_repeats"])
