"""Which records hold most of the words of which others, without comparing all pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.durable import written
from claimloom.functions.text import collapse, words

#: Characters of the pieces on which words and tokens are joined, but for shorter words; pieces of a word that are weighed; records of a block that are compared with one another.
PIECE, WEIGHED, TARGETS, CANDIDATES = 3, 8, 20_000, 1_000
#: Targets and candidates of a block in which the least is looked for; candidates up to which a word is kept as their list.
ASKED, BITS, FEW = 100_000, 65_536, 256


def containing(targets: DataFrame, candidates: DataFrame, share: float) -> DataFrame:
    """``target_id, candidate_id``: candidates that hold at least ``share`` of the target's words.

    Both have ``id`` and ``words`` (arrays of distinct words). A candidate that holds that much misses
    few words, so it holds one of the target's rarest ones: those alone are joined on, the rest is
    checked by intersection. Targets without words match nothing.
    """
    often = candidates.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    listed = targets.select(F.col("id").alias("target_id"), F.size("words").alias("size"), F.explode("words").alias("word")).join(often, "word", "left")
    ordered = listed.groupBy("target_id", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word").alias("word")))).alias("o"))
    need = F.ceil(F.col("size") * share - 1e-9)
    prefix = ordered.select("target_id", F.explode(F.slice("o", F.lit(1), (F.col("size") - need + 1).cast("int"))).alias("p")).where("p.n > 0").select("target_id", F.col("p.word").alias("word"))
    inverted = candidates.select(F.col("id").alias("candidate_id"), F.explode("words").alias("word"))
    pairs = prefix.join(inverted, "word").select("target_id", "candidate_id").distinct()
    full = pairs.join(targets.select(F.col("id").alias("target_id"), F.col("words").alias("tw")), "target_id").join(candidates.select(F.col("id").alias("candidate_id"), F.col("words").alias("cw")), "candidate_id")
    return full.where(F.size(F.array_intersect("tw", "cw")) >= F.ceil(F.size("tw") * share - 1e-9)).select("target_id", "candidate_id")


def _pieces(x: str, n: int) -> Column:
    """All substrings of ``n`` characters."""
    return F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def substrings(wanted: DataFrame, tokens: DataFrame, keys: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """``keys, word, token``: the tokens that hold a word as a substring, within equal keys.

    Both inputs are distinct, without white space and not empty; words have ``least`` characters or more.
    A word is joined on its rarest piece of three characters (``least``, if more; shorter words are their
    own piece), then the whole word is checked. Only pieces that a word has are kept of the tokens. Joins with
    exploded rows are by sorting: their size is estimated as that before the explosion, and broadcast.
    """
    most = max(least, PIECE)
    # Any piece of a word will do: of long words some are weighed, evenly spaced.
    step = F.ceil(F.greatest(F.length("word") - most + 1, F.lit(1)) / WEIGHED)
    some = F.filter(_pieces("word", most), lambda p, i: i % step == 0)
    listed = wanted.select(*keys, "word", F.explode(F.when(F.length("word") < most, F.array("word")).otherwise(F.array_distinct(some))).alias("piece"))
    listed = written(listed, "pieces")
    sizes = [r[0] for r in listed.select(F.length("piece")).distinct().collect()]  # as many as ``most`` at the most
    if not sizes:
        return wanted.limit(0).join(tokens.limit(0), list(keys)).select(*keys, "word", "token") if keys else wanted.limit(0).crossJoin(tokens.limit(0)).select("word", "token")
    every = tokens.select(*keys, "token", F.explode(F.array_distinct(F.concat(*(_pieces("token", n) for n in sizes)))).alias("piece"))
    made = written(every.join(written(listed.select(*keys, "piece").distinct(), "asked-pieces"), [*keys, "piece"], "left_semi"), "made")
    often = made.groupBy(*keys, "piece").agg(F.count("*").alias("n"))
    rarest = listed.join(often, [*keys, "piece"], "left").groupBy(*keys, "word").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), F.col("piece"))).alias("piece"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0").drop("n")
    return rarest.join(made, [*keys, "piece"]).where(F.contains("token", F.col("word"))).select(*keys, "word", "token")


def holding(wanted: DataFrame, texts: DataFrame, least: int = 1) -> DataFrame:
    """``word, id``: the texts (``id, text``) that hold a word as a substring.

    A word without white space stands in a text exactly if it stands in one of its tokens, so words are
    looked for in distinct tokens only.
    """
    listed = texts.select("id", F.explode(F.array_distinct(words("text"))).alias("token"))
    return substrings(wanted, listed.select("token").distinct(), least=least).join(listed.hint("merge"), "token").select("word", "id").distinct()


def overlapping(targets: DataFrame, held: DataFrame) -> DataFrame:
    """``target_id, candidate_id``: all pairs in which a candidate holds at least ``need`` of the target's words.

    ``targets`` has ``id, words, need``, repeats of a word counting each time; ``held`` is a result of
    :func:`holding`. Where small shares suffice nearly all pairs have a word in common, so blocks of
    targets and candidates are counted as bytes of a matrix; work grows with the product of both, as the
    result does.
    """
    held = held.groupBy("id").agg(F.collect_list("word").alias("words"))
    rows, columns = (max(1, math.ceil(df.count() / most)) for df, most in ((targets, TARGETS), (held, CANDIDATES)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = targets.select("id", "words", "need", block(rows).alias("r"), every(columns).alias("c"))
    right = held.select("id", "words", block(columns).alias("c"), every(rows).alias("r"))

    def count(t: pa.Table, c: pa.Table) -> pa.Table:
        found, who = [], []
        if t.num_rows and c.num_rows:
            t, c = t.combine_chunks(), c.combine_chunks()
            asked, has = (x.column("words").combine_chunks() for x in (t, c))
            known = pc.unique(has.flatten())
            there = np.zeros((len(known) + 1, c.num_rows), np.uint8)  # the last row is for words that none holds
            there[pc.index_in(has.flatten(), known).to_numpy(zero_copy_only=False), pc.list_parent_indices(has).to_numpy()] = 1
            word = pc.fill_null(pc.index_in(asked.flatten(), known), len(known)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False))
            for i, (end, need) in enumerate(zip(ends, t.column("need").to_numpy())):
                ids = word[ends[i - 1] if i else 0 : end]
                ids = ids[ids < len(known)]
                if len(ids) >= need:
                    hit = np.flatnonzero(there[ids].sum(0, dtype=np.uint32) >= need)
                    if len(hit):
                        found.append(hit)
                        who.append(i)
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        ids = c.column("id").combine_chunks().cast(pa.string()).take(pa.array(np.concatenate(found))) if found else pa.array([], pa.string())
        return pa.table({"target_id": t.column("id").cast(pa.string()).take(pa.array(who, pa.int64())), "ids": pa.ListArray.from_arrays(offsets, ids)})

    got = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(count, "target_id string, ids array<string>")
    return got.select("target_id", F.explode("ids").alias("candidate_id"))


def whole_in(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """``target_id, candidate_id``: the candidates (``id, text``) that hold a target's ``quote`` (``id, quote``) letter for letter.

    The inner words of a quote, bounded by white space within it, are words of any text that holds it, so
    the rarest of them is joined on. A quote of one or two words has none: its longest word is part of a
    word of the text. Quotes that are blank or NULL match nothing.
    """
    w = targets.select(F.col("id").alias("target_id"), "quote", words("quote").alias("w")).where(F.size("w") > 0)
    listed = written(candidates.select("id", F.explode(F.array_distinct(F.split(collapse("text"), " "))).alias("word")).where("word <> ''"), "listed")
    often = listed.groupBy("word").agg(F.count("*").alias("n"))
    least = F.array_min(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word").alias("word"))))
    inner = w.where(F.size("w") > 2).select("target_id", "quote", F.explode(F.slice("w", F.lit(2), F.size("w") - 2)).alias("word"))
    pairs = inner.join(often, "word", "left").groupBy("target_id", "quote").agg(least.alias("x")).where("x.n > 0").select("target_id", "quote", F.col("x.word").alias("word")).join(listed, "word").select("target_id", "quote", "id")
    short = w.where(F.size("w") <= 2).select("target_id", "quote", F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))["word"].alias("word"))
    if not short.isEmpty():
        found = substrings(short.select("word").distinct(), listed.select(F.col("word").alias("token")).distinct())
        among = found.join(listed.withColumnRenamed("word", "token"), "token").select("word", "id").distinct()
        pairs = pairs.unionByName(short.join(among, "word").select("target_id", "quote", "id"))
    return pairs.join(candidates, "id").where(F.contains("text", F.col("quote"))).select("target_id", F.col("id").alias("candidate_id"))


def least_covering(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """``target_id, candidate_id``: the least id of the candidates (``id, text``) that hold at least ``need`` of the target's words as substrings.

    ``targets`` has ``id, words, need`` and is read several times; repeats of a word count each time, and
    words are without white space. Targets without words match nothing.

    Blocks of targets meet blocks of candidates in the order of their ids. What a candidate holds is a bit
    for each of the words that many of a block hold, so that a target's words are counted for 64 candidates
    at a time, once for all targets that share these words; words that few hold are counted by their lists.
    Only targets that find nothing in the block of the least ids meet the other blocks.
    """
    # Numbers in the order of the ids stand for them, as they are shorter.
    c = written(candidates.where("id IS NOT NULL").orderBy("id").select("id", F.array_distinct(F.split(collapse("text"), " ")).alias("tokens"), F.monotonically_increasing_id().alias("no")), "numbered")
    listed = c.select("no", F.explode("tokens").alias("token")).where("token <> ''")
    found = substrings(targets.select(F.explode("words").alias("word")).distinct(), listed.select("token").distinct())
    each = found.groupBy("token").agg(F.collect_list("word").alias("words")).join(listed.hint("merge"), "token").groupBy("no")
    held = written(each.agg(F.array_join(F.array_distinct(F.flatten(F.collect_list("words"))), " ").alias("words")), "held")
    asked = targets.where(F.size("words") > 0).select("id", F.array_join("words", " ").alias("words"), F.col("need").cast("int").alias("need"))
    blocks, n = math.ceil(held.count() / BITS), targets.count()
    if blocks > 1:
        last = held.select("no").orderBy("no").limit(BITS).agg(F.max("no")).first()[0]
        first = written(_least(asked, held.where(F.col("no") <= last), n, 1), "first")
        rest = asked.join(first.select(F.col("target_id").alias("id")), "id", "left_anti")
        got = first.unionByName(_least(rest, held.where(F.col("no") > last), n - first.count(), blocks - 1))
    else:
        got = _least(asked, held, n, 1)
    return got.groupBy("target_id").agg(F.min("no").alias("no")).join(c.select("no", F.col("id").alias("candidate_id")), "no").select("target_id", "candidate_id")


def _least(targets: DataFrame, held: DataFrame, n: int, columns: int) -> DataFrame:
    """``target_id, no``: the least ``no`` of each of so many blocks of ``held`` (``no, words``) that has ``need`` of the words of a target (``id, words, need``); about ``n`` targets."""
    cores = targets.sparkSession.sparkContext.defaultParallelism
    rows = max(1, math.ceil(n / ASKED), min(math.ceil(2 * cores / columns), math.ceil(n / 2_000)))
    block = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = targets.select("*", block("id", rows).alias("r"), every(columns).alias("c"))
    right = held.select("*", block("no", columns).alias("c"), every(rows).alias("r"))

    def least(t: pa.Table, c: pa.Table) -> pa.Table:
        at, first = [], []
        if t.num_rows and c.num_rows:
            t, c = t.combine_chunks(), c.sort_by("no").combine_chunks()
            asked, has = (pc.split_pattern(x.column("words").combine_chunks(), " ") for x in (t, c))
            known = pc.unique(asked.flatten())
            word = pc.index_in(has.flatten(), known)
            there = pc.is_valid(word).to_numpy(zero_copy_only=False)
            some = _Postings(pc.drop_null(word).to_numpy(zero_copy_only=False), pc.list_parent_indices(has).to_numpy()[there], len(known), c.num_rows)
            word = pc.index_in(asked.flatten(), known).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False))
            for i, (end, need) in enumerate(zip(ends.tolist(), t.column("need").to_pylist())):
                hit = some.least(word[ends[i - 1] if i else 0 : end], need)
                if hit < c.num_rows:
                    at.append(i)
                    first.append(hit)
        return pa.table({"target_id": t.column("id").take(pa.array(at, pa.int64())), "no": c.column("no").take(pa.array(first, pa.int64()))})

    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(least, f"target_id {targets.schema['id'].dataType.simpleString()}, no bigint")


class _Postings:
    """Which of ``n`` candidates hold which of ``known`` words: ``word`` and ``who`` are pairs of both, ``who`` ascending."""

    def __init__(self, word: np.ndarray, who: np.ndarray, known: int, n: int) -> None:
        self.n, self.often = n, np.bincount(word, minlength=known)
        self.starts, self.who = np.concatenate(([0], np.cumsum(self.often))), who[np.argsort(word, kind="stable")]
        many = np.flatnonzero(self.often > FEW)
        self.place = np.full(known, -1)
        self.place[many] = np.arange(len(many))
        self.bits = np.zeros((len(many), -(-n // 64)), "<u8")
        row = np.zeros(self.bits.shape[1] * 64, bool)
        for i, w in enumerate(many):
            row[:] = False
            row[self.of(w)] = True
            self.bits[i] = np.packbits(row, bitorder="little").view("<u8")
        self.done: dict[tuple[bytes, int], int] = {}

    def of(self, w: int) -> np.ndarray:
        return self.who[self.starts[w] : self.starts[w + 1]]

    def least(self, words: np.ndarray, need: int) -> int:
        """The least candidate that holds ``need`` of ``words``; ``n`` if there is none."""
        words = words[self.often[words] > 0]
        if len(words) < need:
            return self.n
        place = self.place[words]
        many, few = np.sort(place[place >= 0]), words[place < 0]
        best = self.n
        if len(many) >= need:
            key = many.tobytes(), need
            if key not in self.done:
                self.done[key] = self._among(many, len(many) - need)
            best = self.done[key]
        if len(few):  # candidates that hold one of these at least
            who, n = np.unique(np.concatenate([self.of(w) for w in few]), return_counts=True)
            near = (n >= need - len(many)) & (who < best)
            if near.any():
                who, n = who[near], n[near]
                if len(many):
                    n = n + (self.bits[many[:, None], who >> 6] >> (who & 63).astype("<u8") & np.uint64(1)).sum(0)
                enough = np.flatnonzero(n >= need)
                if len(enough):
                    best = int(who[enough[0]])
        return best

    def _among(self, many: np.ndarray, spare: int) -> int:
        """The least candidate that holds all but ``spare`` of these words."""
        if spare == 0:
            left = np.bitwise_and.reduce(self.bits[many], axis=0)
        else:
            # lacks[j]: candidates that lack j of the words so far at most.
            lacks = np.full((spare + 1, self.bits.shape[1]), ~np.uint64(0))
            for b in self.bits[many]:
                for j in range(spare, 0, -1):
                    lacks[j] &= b
                    lacks[j] |= lacks[j - 1]
                lacks[0] &= b
            left = lacks[spare]
        full = np.flatnonzero(left)
        if not len(full):
            return self.n
        x = int(left[full[0]])
        return min(self.n, int(full[0]) * 64 + (x & -x).bit_length() - 1)
