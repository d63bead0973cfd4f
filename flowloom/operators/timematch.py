"""Time-based matching of the two sensors.

Inputs carry a unique row number (``a_seq`` / ``z_seq``, the file or arrival order) and a
time in integer microseconds (``a_us`` / ``z_us``).
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.matching import fifo_match
from flowloom.operators.scan import BLOCK_WIDTH, SEQUENCE_WIDTH, Running, ordinal, own_exchange, sorted_scan
from flowloom.session import stored


# --- set-based band predicates ------------------------------------------------

def _band_partners(a: DataFrame, delta: int) -> DataFrame:
    """Per time bucket: is it occupied, latest time just before it, earliest just after.

    Two numbers per bucket decide whether a partner within ``delta`` exists, so no
    candidate pairs are formed however many rows share a bucket.
    """
    width = max(delta, 1)
    bucket = F.floor(F.col("a_us") / width).cast("bigint")
    ends = a.groupBy(bucket.alias("k")).agg(F.min("a_us").alias("lo"), F.max("a_us").alias("hi"))
    # width 1 stands for delta 0: neighbours never qualify then
    spread = ends.select("lo", "hi", F.explode(F.array(
        F.struct(F.col("k").alias("k"), F.lit(0).alias("side")),
        F.struct((F.col("k") + 1).alias("k"), F.lit(-1).alias("side")),
        F.struct((F.col("k") - 1).alias("k"), F.lit(1).alias("side")))).alias("t"))
    return spread.groupBy(F.col("t.k").alias("__k")).agg(
        F.bool_or(F.col("t.side") == 0).alias("__same"),
        F.max(F.when(F.col("t.side") == -1, F.col("hi"))).alias("__before"),
        F.min(F.when(F.col("t.side") == 1, F.col("lo"))).alias("__after"))


def _with_band(a: DataFrame, z: DataFrame, delta: int) -> DataFrame:
    partners = _band_partners(a, delta)
    keyed = z.withColumn("__k", F.floor(F.col("z_us") / max(delta, 1)).cast("bigint"))
    hit = (F.col("__same") | (F.col("__before") >= F.col("z_us") - delta)
           | (F.col("__after") <= F.col("z_us") + delta))
    return keyed.join(partners, "__k", "left").withColumn("__hit", F.coalesce(hit, F.lit(False)))


def band_semi(a: DataFrame, z: DataFrame, delta: int) -> DataFrame:
    """Rows of ``z`` with at least one ``a`` row within ``delta``."""
    return _with_band(a, z, delta).where("__hit").select(*z.columns)


def band_anti(a: DataFrame, z: DataFrame, delta: int) -> DataFrame:
    """Rows of ``z`` with no ``a`` row within ``delta``."""
    return _with_band(a, z, delta).where("not __hit").select(*z.columns)


# --- deferred acceptance over blocks -------------------------------------------
#
# Both matches below are greedy in the order of one side's rows: each takes the best partner that no earlier
# row took. That is the one stable matching in which every partner prefers the earlier row, so it may be found in
# any order of proposals: a row asks its best partner first, a partner drops a later row for an earlier one, and a
# dropped row asks its next best. Partners are cut into blocks along the order of preference. A block answers all
# rows that ever asked it, in their order; rows it has no partner for ask the next block they can reach. Only these
# cross a border, and only blocks that got new ones answer again. Where rows are refused along the whole table, blocks
# settle one after the other; there are few of them, then, since they grow with the table.

# Blocks that the longest order of preference is cut into at most, as long as none is above BLOCK_LIMIT rows.
BLOCKS = 20
BLOCK_LIMIT = 1 << 20
# Rounds that are kept apart before they are put together.
ROUNDS = 16


def block_rows(longest: int, least: int) -> int:
    """Rows of a block for orders of up to ``longest`` rows."""
    return max(least, min(-(-longest // BLOCKS), BLOCK_LIMIT))


def settle(first: DataFrame, answer: Callable[[DataFrame], DataFrame], onward: Callable[[DataFrame], DataFrame],
           block: list[str], row: str) -> DataFrame:
    """Proposals with the ``hit`` that each ends with, from the block that grants it.

    ``first`` holds a proposal per row: its ``block`` columns, the number ``row``, and what ``answer`` needs. ``answer``
    adds ``hit`` (null: none) to whole blocks of proposals; ``onward`` turns refused ones into proposals to later blocks.
    """
    asked = [stored(first)]
    todo, rounds = asked[0], []
    while True:
        rounds.append(stored(answer(todo).withColumn("round", F.lit(len(asked)))))
        if len(rounds) > ROUNDS:
            rounds = [stored(_latest(rounds, block))]
        refused = onward(rounds[-1].where(f"hit is null and round = {len(asked)}").drop("hit", "round"))
        known = reduce(DataFrame.unionByName, [a.select(*block, row) for a in asked])
        fresh = stored(refused.join(known, [*block, row], "left_anti"))
        if fresh.isEmpty():
            return _latest(rounds, block).where("hit is not null").drop("round")
        asked.append(fresh)
        todo = reduce(DataFrame.unionByName, asked).join(F.broadcast(fresh.select(*block).distinct()), block, "left_semi")


def _latest(rounds: list[DataFrame], block: list[str]) -> DataFrame:
    """What each block answered last."""
    if len(rounds) == 1:
        return rounds[0]
    last = reduce(DataFrame.unionByName, [r.select(*block, "round").distinct() for r in rounds]).groupBy(*block).agg(F.max("round").alias("round"))
    return reduce(DataFrame.unionByName, rounds).join(last, [*block, "round"], "left_semi")


# --- nearest-time one-to-one match --------------------------------------------

def nearest_time_match(a: DataFrame, z: DataFrame, delta: int, width: int = BLOCK_WIDTH,
                       block: int = SEQUENCE_WIDTH) -> DataFrame:
    """Each z row, in row order, takes the smallest unused a time within ``delta``.

    With ``delta`` 0 this is first in, first out pairing on the timestamp. Otherwise a rows are numbered
    by time and cut into blocks of at least ``block`` rows, whatever the density, and a z row asks for the first
    free number of its window. Records may come in any order of time. Rows without a time match nothing.
    """
    if delta == 0:
        pairs = fifo_match(a.withColumn("__t", F.col("a_us")), z.withColumn("__t", F.col("z_us")), "__t", width=width)
        return pairs.select("a_seq", "a_us", "z_seq", "z_us")

    def points(df, seq, us, side):
        # at equal times: window starts, then a rows, then window ends
        return df.select((us * 3 + F.lit([1, 0, 2][side])).alias("at"), F.lit(side).alias("side"),
                         F.col(seq).alias("seq"))
    line = (points(a, "a_seq", F.col("a_us"), 0).unionByName(points(z, "z_seq", F.col("z_us") - delta, 1))
            .unionByName(points(z, "z_seq", F.col("z_us") + delta, 2)).where(F.col("at").isNotNull()))
    seen = stored(sorted_scan(line, [], ["at", "side", "seq"], [
        Running("a_seen", (F.col("side") == 0).cast("bigint"), inclusive=False)]))
    block = block_rows(seen.where("side = 0").count(), block)
    starts = seen.where("side = 1").select("seq", F.col("a_seen").alias("lo"),
                                           (F.floor(F.col("at") / 3) + delta).cast("bigint").alias("z_us"))
    ends = seen.where("side = 2").select("seq", F.col("a_seen").alias("hi"))
    windows = starts.join(ends, "seq").where("hi > lo").withColumn("blk", F.expr(f"lo div {block}"))

    def answer(asked: DataFrame) -> DataFrame:
        ordered = asked.repartition(own_exchange("blk")).sortWithinPartitions("blk", "seq")
        return ordered.mapInPandas(lambda batches: _first_free(batches, block),
                                   "seq bigint, lo bigint, z_us bigint, hi bigint, blk bigint, hit bigint")

    def onward(refused: DataFrame) -> DataFrame:
        return refused.withColumn("blk", F.col("blk") + 1).where(F.col("hi") > F.col("blk") * block)
    taken = settle(windows, answer, onward, ["blk"], "seq").select(
        F.col("hit").alias("a_seen"), F.col("seq").alias("z_seq"), "z_us")
    numbered = seen.where("side = 0").select(
        "a_seen", F.col("seq").alias("a_seq"), F.floor(F.col("at") / 3).cast("bigint").alias("a_us"))
    return numbered.join(taken, "a_seen").select("a_seq", "a_us", "z_seq", "z_us")


def _first_free(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by block and order take the first free number of their window inside the block."""
    current, following = None, []
    for batch in batches:
        hits = []
        for blk, lo, hi in zip(*[batch[c].tolist() for c in ("blk", "lo", "hi")]):
            if blk != current:
                current, following = blk, array("q", range(block + 1))
            pick = _unused(following, max(lo - blk * block, 0))
            if pick < min(hi - blk * block, block):
                following[pick] = pick + 1
                hits.append(blk * block + pick)
            else:
                hits.append(None)
        yield batch.assign(hit=pd.array(hits, dtype="Int64"))


def _unused(following: array, i: int) -> int:
    """First unused position at or after ``i`` (path halving)."""
    while following[i] != i:
        following[i] = following[following[i]]
        i = following[i]
    return i


# --- keyed interval match in arrival order ------------------------------------

def interval_match(a: DataFrame, z: DataFrame, tolerance: int, key: str = "key", block: int = SEQUENCE_WIDTH) -> DataFrame:
    """Equal key and times within ``tolerance``: an arrival takes the oldest-arrived partner.

    ``a_seq`` and ``z_seq`` share one arrival order. An arrival that finds nobody waits and is taken by
    a later one, so either side prefers the partner that arrived first: a rows, in their order, take the first
    free z row within the tolerance. The z rows of a key are cut into blocks of at least ``block`` arrivals; an a row asks
    those blocks that hold a z row of its own or a neighbouring stretch of time, however busy the key and however
    late the row. Rows without a key or time match nothing.
    """
    width = max(tolerance, 1)

    def stretch(us: str) -> Column:
        return F.expr(f"cast(floor({us} / {width}) as bigint)")
    z = z.select(F.col(key).alias("key"), "z_seq", "z_us").where("key is not null and z_us is not null")
    numbered = stored(ordinal(z, ["key"], "z_seq", "nth"))
    block = block_rows(numbered.agg(F.coalesce(F.max("nth"), F.lit(0))).first()[0], block)
    placed = numbered.select("key", "z_seq", "z_us", F.expr(f"(nth - 1) div {block}").alias("blk"))
    held = placed.select("key", stretch("z_us").alias("stretch"), "blk").distinct()
    # as many rows of a stretch as it has blocks
    nexts = stored(held.select("*", F.lead("blk").over(Window.partitionBy("key", "stretch").orderBy("blk")).alias("next")))
    opening = nexts.groupBy("key", "stretch").agg(F.min("blk").alias("blk"))

    first = a.select(F.col(key).alias("key"), F.col("a_seq").alias("seq"), F.col("a_us").alias("us")).where(
        "key is not null and us is not null")
    for d in (-1, 0, 1):
        first = first.join(opening.select("key", (F.col("stretch") - d).alias("__s"), F.col("blk").alias(f"p{d + 1}")),
                           (first["key"] == opening["key"]) & (stretch("us") == F.col("__s")), "left").select(
            first["*"], f"p{d + 1}")
    asked = ["key", "seq", "us", "p0", "p1", "p2"]
    first = first.select(*asked, F.least("p0", "p1", "p2").alias("blk")).where("blk is not null")

    def answer(todo: DataFrame) -> DataFrame:
        blocks = placed.join(todo.select("key", "blk").distinct(), ["key", "blk"], "left_semi")
        rows = todo.withColumn("side", F.lit(1)).unionByName(blocks.select(
            "key", "blk", F.col("z_seq").alias("seq"), F.col("z_us").alias("us"), F.lit(0).alias("side")), allowMissingColumns=True)
        ordered = rows.repartition(own_exchange("key", "blk")).sortWithinPartitions("key", "blk", "side", "seq")
        return ordered.mapInPandas(lambda batches: _first_arrived(batches, tolerance), (
            "key string, seq bigint, us bigint, p0 bigint, p1 bigint, p2 bigint, blk bigint, hit bigint, hit_us bigint"))

    def onward(refused: DataFrame) -> DataFrame:
        out = refused.select(*asked, "blk")
        for d in (-1, 0, 1):
            p = f"p{d + 1}"
            step = nexts.select(F.col("key").alias("__k"), (F.col("stretch") - d).alias("__s"), F.col("blk").alias("__b"), "next")
            out = out.join(step, (F.col("key") == F.col("__k")) & (stretch("us") == F.col("__s"))
                           & (F.col("blk") == F.col("__b")) & (F.col(p) == F.col("__b")), "left").withColumn(
                p, F.when(F.col(p) == F.col("blk"), F.col("next")).otherwise(F.col(p))).select(*asked, "blk")
        return out.withColumn("blk", F.least("p0", "p1", "p2")).where("blk is not null")
    return settle(first, answer, onward, ["key", "blk"], "seq").select(
        "key", F.col("seq").alias("a_seq"), F.col("us").alias("a_us"), F.col("hit").alias("z_seq"), F.col("hit_us").alias("z_us"))


class _FreeByTime:
    """Free rows of a block: the first to arrive within a range of times, and taking it, in logarithmic time."""

    def __init__(self, times: array):
        order = sorted(range(len(times)), key=times.__getitem__)
        self.times = array("q", (times[i] for i in order))
        self.n = n = len(order)
        # a tree of minima: the leaves are arrival ranks by time, rank n stands for a taken row
        self.tree = array("q", [n]) * n + array("q", order)
        for i in range(n - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])
        self.leaf = array("q", [0]) * n
        for i, rank in enumerate(order):
            self.leaf[rank] = i + n

    def take(self, low: int, high: int) -> int | None:
        """Rank of the first arrival with a time from ``low`` to ``high``, which is no longer free then."""
        tree, best = self.tree, self.n
        i, j = bisect_left(self.times, low) + self.n, bisect_right(self.times, high) + self.n
        while i < j:
            if i & 1:
                best = min(best, tree[i])
                i += 1
            if j & 1:
                j -= 1
                best = min(best, tree[j])
            i, j = i >> 1, j >> 1
        if best == self.n:
            return None
        i = self.leaf[best]
        tree[i] = self.n
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        return best


def _first_arrived(batches: Iterator[pd.DataFrame], tolerance: int) -> Iterator[pd.DataFrame]:
    """Blocks of z rows (side 0), each followed by the a rows that ask it; one block of z rows is held."""
    current, seqs, times, free = None, array("q"), array("q"), None
    for batch in batches:
        hits, at = [], []
        for key, blk, side, seq, us in zip(*[batch[c].tolist() for c in ("key", "blk", "side", "seq", "us")]):
            if (key, blk) != current:
                current, seqs, times, free = (key, blk), array("q"), array("q"), None
            rank = None
            if side == 0:
                seqs.append(seq)
                times.append(us)
            else:
                free = free or _FreeByTime(times)
                rank = free.take(us - tolerance, us + tolerance)
            hits.append(None if rank is None else seqs[rank])
            at.append(None if rank is None else times[rank])
        out = batch.assign(hit=pd.array(hits, dtype="Int64"), hit_us=pd.array(at, dtype="Int64"))
        yield out[out["side"] == 1].drop(columns="side").astype({p: "Int64" for p in ("p0", "p1", "p2")})


# --- results ------------------------------------------------------------------

def unmatched(side: DataFrame, pairs: DataFrame, seq: str) -> DataFrame:
    """Rows of one side that no pair contains."""
    return side.join(pairs.select(seq), seq, "left_anti")


def inexact_matches(pairs: DataFrame) -> DataFrame:
    """Pairs whose times differ."""
    return pairs.where(F.col("a_us") != F.col("z_us"))


def match_summary(a: DataFrame, z: DataFrame, pairs: DataFrame) -> DataFrame:
    """Totals, matches and leftovers of both sides in one row.

    ``z`` may contain rows without a readable time; they count as records and are also
    reported as ``invalid_b``, and stay part of ``unmatched_b``.
    """
    def tagged(df, tag, extra):
        return df.select(F.lit(tag).alias("t"), extra.cast("bigint").alias("x"))
    rows = (tagged(a, "a", F.lit(0)).unionByName(tagged(z, "z", F.col("z_us").isNull()))
            .unionByName(tagged(pairs, "m", F.col("a_us") != F.col("z_us"))))
    n = {t: F.count_if(F.col("t") == t) for t in ("a", "z", "m")}

    def extra(t):
        return F.coalesce(F.sum(F.when(F.col("t") == t, F.col("x"))), F.lit(0))
    return rows.agg(n["z"].alias("total_b"), n["a"].alias("total_a"), n["m"].alias("matched"),
                    extra("m").alias("inexact"), (n["z"] - n["m"]).alias("unmatched_b"),
                    (n["a"] - n["m"]).alias("unmatched_a"), extra("z").alias("invalid_b"))
