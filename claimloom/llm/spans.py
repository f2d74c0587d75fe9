"""Long exact spans shared between records, by seed and extend on winnowed anchors.

Every stretch of SPAN code points has one anchor: of its 101 substrings of 100 characters the one with
the least hash. Anchor and offset depend on the stretch alone, so equal stretches have equal anchors.
A text becomes a list of seeds: an anchor with the run of consecutive stretches that it stands for.

Texts are hashed once and their seeds written. Anchors that only one document has are dropped first:
documents' distinct anchors are counted with partial aggregation, eight bytes each, and seeds are joined
with those that repeat. Seeds whose whole run of text is found in two documents are shared entirely (a
partial aggregation, whatever the number of copies). The other runs lie at the ends of shared spans: they
are joined on their anchors, and the matches extended both ways by comparing the stretches at each offset
from the anchor. No pairs of documents are made. Each different run is compared once, however often a text
repeats it (a long rule of hyphens is one run); anchors with very many different runs are compared by one
more aggregation instead of in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimloom.functions.durable import written
from claimloom.functions.parallel import spread

SPAN, ANCHOR = 200, 100
#: Code points handled at once in a task, different runs of an anchor compared in one task, and runs compared at once.
SLICE, MOST_OPEN, TOGETHER = 1 << 19, 1000, 20_000
_U = np.uint64
#: Odd multipliers of a 64-bit mixer and the base of the rolling hash, with its inverse modulo 2^64.
_M1, _M2, _BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as many as a slice needs."""
    n = SLICE + SPAN + 1
    return tuple(np.multiply.accumulate(np.r_[_U(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, _INVERSE))


@cache
def _symbols() -> np.ndarray:
    return _mix((np.arange(1 << 16, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))


class _Hashes:
    """Hashes of all substrings of some text, by differences of prefix sums."""

    def __init__(self, points: np.ndarray):
        small = len(points) == 0 or points.max() < 1 << 16
        symbols = _symbols()[points] if small else _mix((points.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
        power, self.inverse = _powers()
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(symbols * power[: len(points)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def all(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every window of that width: prefix and suffix minima of blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _seeds_of(points: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, number of stretches, offset of the anchor, anchor hash and run hash of all seeds.

    ``room``: for each position how many code points of its document are left there.
    """
    if len(points) < SPAN:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    hashes = _Hashes(points)
    grams = hashes.all(ANCHOR)
    low = _U((1 << 24) - 1)
    order = (_mix(grams) & ~low) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
    at = (_least(order, SPAN - ANCHOR + 1) & low).astype(np.int64)
    whole = np.flatnonzero(room[: len(at)] >= SPAN)
    if not len(whole):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    at = at[whole]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)])
    n = np.diff(np.r_[first, len(whole)])
    start, at = whole[first], at[first]
    run = _mix(hashes.of(start, start + n - 1 + SPAN) + (n * 1024 + (at - start)).astype(np.uint64) * _M2)
    return start, n, at - start, grams[at], run


def _slices(ids: list, texts: list) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to slices of bounded length: ids, and per slice the code points, the room left, and per
    position the document's place in ids and the offset in it. A text longer than a slice goes in overlapping parts."""

    def out(parts):
        points = np.frombuffer("".join(p for _, p, _, _ in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(p) for _, p, _, _ in parts])
        of = np.repeat(np.arange(len(parts)), sizes)
        offset = np.arange(len(points)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        room = np.repeat(sizes, sizes) - offset
        return [i for i, _, _, _ in parts], points, room, of, offset + np.array([o for _, _, o, _ in parts])[of]

    held, n = [], 0
    for i, t in zip(ids, texts, strict=True):
        if t is None or len(t) < SPAN:
            continue
        for o in range(0, max(1, len(t) - SPAN + 1), SLICE - SPAN + 1):
            part = t[o : o + SLICE]
            if n + len(part) > SLICE:
                yield out(held)
                held, n = [], 0
            held.append((i, part, o, None))
            n += len(part)
    if held:
        yield out(held)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, points, room, of, offset in _slices(b.column(0).to_pylist(), b.column(1).to_pylist()):
            start, n, at, anchor, run = _seeds_of(points, room)
            order = np.lexsort((anchor, of[start]))
            doc, h = of[start][order], anchor[order]
            first = np.zeros(len(start), bool)
            first[order] = np.r_[len(start) > 0, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(start)]
            place = (offset[start].astype(np.int64) << 16) | (n << 9) | (at << 2) | first
            columns = [np.array(ids, np.int64)[of[start]], place, anchor.view(np.int64), run.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "place", "h", "run"])


def _unfolded() -> tuple[Column, Column, Column]:
    """What a seed's place holds: where its run starts, its number of stretches, and the offset of its anchor."""
    return F.shiftright("place", 16).cast("int"), F.shiftright("place", 9).bitwiseAND(127).cast("int"), F.shiftright("place", 2).bitwiseAND(127).cast("int")


def seeds(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``doc, place, h, run`` of every seed of every text of at least SPAN code points.

    The last bit of ``place`` is set for the first seed of each anchor in a text (in a text longer than a
    slice, in each slice).
    """
    return df.select(record_id, text).mapInArrow(_seeds, "doc bigint, place bigint, h bigint, run bigint")


def repeated_anchors(made: DataFrame) -> DataFrame:
    """``h`` of the anchors that several texts have, and perhaps of some that a very long one has twice."""
    return made.where(F.col("place").bitwiseAND(1) == 1).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with lists of their seeds in, the hashes of each seed's stretches out."""
    names = ["h", "run", "at", "least", "most", "hot"]
    for b in batches:
        rows = {k: [] for k in names}
        hashes = []
        for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            for s in wanted:
                part = text[s["start"] : s["start"] + s["n"] - 1 + SPAN]
                h = _Hashes(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)).all(SPAN)
                hashes.append(h.view(np.int64))
                for k in names:
                    rows[k].append(s[k])
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([*(pa.array(rows[k], t) for k, t in zip(names, kinds, strict=True)), pa.array(hashes, pa.list_(pa.int64()))], [*names, "stretches"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of their anchors in; of those that one document alone has, the stretches that another has too out.

    Some whole anchors are compared at a time, so memory does not grow with the partition.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= TOGETHER:
            t = pa.Table.from_batches(held).combine_chunks()
            h = t.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
            if whole:
                yield from _compared(t.slice(0, whole))
                held, rows = t.slice(whole).to_batches(), len(h) - whole
    if rows:
        yield from _compared(pa.Table.from_batches(held).combine_chunks())


def _compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    lists = t.column("stretches").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    get = lambda c: t.column(c).to_numpy()
    stretch = lists.flatten().to_numpy()
    h, distance = get("h")[row], get("at")[row] - nth
    # Equal are stretches of equal hash at equal distance from equal anchors: all three are compared.
    order = np.lexsort((stretch, distance, h))
    new = [x[order][1:] != x[order][:-1] for x in (h, distance, stretch)]
    first = np.flatnonzero(np.r_[True, new[0] | new[1] | new[2]])
    least, most = np.minimum.reduceat(get("least")[row][order], first), np.maximum.reduceat(get("most")[row][order], first)
    shared = np.zeros(len(row), bool)
    shared[order] = np.repeat(least != most, np.diff(np.r_[first, len(row)]))
    at = np.flatnonzero(shared & (get("least") == get("most"))[row])
    if len(at):
        begin = np.flatnonzero(np.r_[True, (row[at][1:] != row[at][:-1]) | (at[1:] != at[:-1] + 1)])
        i, length = at[begin], np.diff(np.r_[begin, len(at)])
        yield pa.RecordBatch.from_arrays([pa.array(get("h")[row[i]]), pa.array(get("run")[row[i]]), pa.array(nth[i]), pa.array(nth[i] + length - 1 + SPAN)], ["h", "run", "a", "b"])


def merged(intervals: DataFrame) -> DataFrame:
    """The union of each document's intervals ``doc, a, b`` as maximal runs ``doc_id, span_start, span_end``."""
    by = W.partitionBy("doc").orderBy("a", "b")
    reach = F.max("b").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    numbered = marked.withColumn("k", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "k").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).select(F.col("doc").alias("doc_id"), "span_start", "span_end")


def shared_spans(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``doc_id, span_start, span_end`` (BIGINT): maximal runs of characters that lie in a stretch of at
    least SPAN code points that also stands in another record.

    Ids are BIGINT and unique. Short, empty and NULL texts have no spans; repeats inside one record only
    do not count. Equality is that of two 64-bit hashes, of the anchor and of the run or stretch.
    """
    start, n, at = _unfolded()
    df = spread(df.where(F.col(record_id).isNotNull()).select(record_id, text))
    made = written(seeds(df, record_id, text), "seeds")
    # Written first, so that its size is known: Spark broadcasts it below its threshold and shuffles the seeds beyond.
    repeated = written(repeated_anchors(made), "repeated")
    rows = written(made.join(repeated, "h", "left_semi"), "kept")
    runs = written(rows.groupBy("h", "run").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min(F.struct("doc", "place")).alias("one")), "runs")
    anchors = runs.groupBy("h").agg(F.min("least").alias("a"), F.max("most").alias("b"), F.count_if(F.col("least") == F.col("most")).alias("n_open"), F.count("*").alias("n_runs")).where("a < b").select("h", "n_open", "n_runs")
    mixed = runs.join(anchors.where("n_open > 0"), "h").select("h", "run", "least", "most", (F.col("n_runs") > MOST_OPEN).alias("hot"), "one.doc", "one.place")
    wanted = mixed.withColumns({"start": start, "n": n, "at": at}).groupBy("doc").agg(F.collect_list(F.struct("start", "n", "at", "h", "run", "least", "most", "hot")).alias("wanted"))
    texts = written(wanted, "wanted").join(df.select(F.col(record_id).alias("doc"), F.col(text).alias("text")), "doc")
    compared = written(texts.mapInArrow(_stretches, "h bigint, run bigint, at int, least bigint, most bigint, hot boolean, stretches array<bigint>"), "ends")
    extended = compared.where("NOT hot").repartition("h").sortWithinPartitions("h").mapInArrow(_compare, "h bigint, run bigint, a bigint, b bigint")
    each = compared.where("hot").select("h", "run", "least", "most", F.posexplode("stretches").alias("i", "stretch"), "at").withColumn("distance", F.col("at") - F.col("i"))
    keys = ["h", "distance", "stretch"]
    common = each.groupBy(*keys).agg(F.min("least").alias("x"), F.max("most").alias("y")).where("x < y").select(*keys)
    crowded = each.where("least = most").join(common, keys).select("h", "run", F.col("i").cast("bigint").alias("a"), (F.col("i") + SPAN).cast("bigint").alias("b"))
    entire = runs.where("least < most").join(rows, ["h", "run"]).select("doc", start.cast("bigint").alias("a"), (start + n - 1 + SPAN).cast("bigint").alias("b"))
    # What was found of a run holds wherever its one document repeats it.
    parts = extended.unionByName(crowded).join(rows, ["h", "run"]).select("doc", (start + F.col("a")).alias("a"), (start + F.col("b")).alias("b"))
    return merged(entire.unionByName(parts))


def shared_shares(df: DataFrame, record_id: str, text: str, spans: DataFrame) -> DataFrame:
    """``doc_id, n_chars, shared_chars, shared_share`` of every record; an empty text's share is 0."""
    sums = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    rows = df.select(F.col(record_id).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared", F.lit(0).cast("bigint"))
    return rows.join(sums, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_share"))
