"""Distributed ordered scans: running aggregates, dense numbering, time-gap islands.

A plain window partitioned by key puts one key into one task, and an unpartitioned
window puts everything into one task. Both fail once a key holds a large share of the
rows. The scans here cut the order axis into fixed-width blocks instead:

1. inside ``(key, block)`` an ordinary window computes the local prefix,
2. ``(key, block)`` totals come from the same exchange and are prefixed over blocks,
3. the prefix of all earlier blocks is joined back and combined with the local prefix.

A window group therefore never exceeds ``width`` order units, whatever the key. The
result is a pure function of the data, so a lost executor recomputes the same values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import cut_lineage

# Order units per block: at most this many arrivals of one key meet in one task.
BLOCK_WIDTH = 1 << 18
# Blocks of the keyless numbering are its only parallelism, so they are narrower.
SEQUENCE_WIDTH = 1 << 16
# Blocks per superblock when the scan has no key.
SUPERBLOCK = 1 << 10

_BLK, _SUP = "__blk", "__sup"


@dataclass(frozen=True)
class Running:
    """One running aggregate of a scan.

    ``kind`` is ``sum``, ``max``, ``min`` or ``last`` (most recent non-null value).
    ``inclusive`` decides whether the current row takes part.
    """

    name: str
    value: Column
    kind: str = "sum"
    inclusive: bool = True


_REDUCE = {
    "sum": lambda v, o: F.sum(v),
    "max": lambda v, o: F.max(v),
    "min": lambda v, o: F.min(v),
    "last": lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)),
}
_OVER = {
    "sum": lambda v, w: F.sum(v).over(w),
    "max": lambda v, w: F.max(v).over(w),
    "min": lambda v, w: F.min(v).over(w),
    "last": lambda v, w: F.last(v, ignorenulls=True).over(w),
}
_COMBINE = {
    "sum": lambda carry, local: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    "max": lambda carry, local: F.greatest(carry, local),
    "min": lambda carry, local: F.least(carry, local),
    "last": lambda carry, local: F.coalesce(local, carry),
}


def _value(i: int) -> str:
    return f"__v{i}"


def _carry(i: int) -> str:
    return f"__c{i}"


def block_index(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def own_exchange(*cols: str) -> Column:
    """Partitioning expression for frames that go into ``mapInPandas``.

    ``mapInPandas`` states no distribution it needs, so a repartition by plain columns may
    be dropped as redundant and the joins below it re-planned at run time without it. A
    derived expression keeps the exchange.
    """
    return F.xxhash64(*cols)


def keyed_scan(df: DataFrame, keys: list[str], order: str, scans: list[Running],
               width: int = BLOCK_WIDTH) -> DataFrame:
    """Append one column per running aggregate, per ``keys`` in ascending ``order``.

    ``order`` must be an integer column, unique within a key. Rows of one key are spread
    over as many tasks as they span blocks.
    """
    work = df.withColumn(_BLK, block_index(order, width))
    return scan_blocks(work, keys, [order], scans, df.columns)


def sorted_scan(df: DataFrame, keys: list[str], order: list[str], scans: list[Running]) -> DataFrame:
    """Like :func:`keyed_scan` for any sortable order; blocks are range partitions.

    The partition number is the block, so the ranged frame is written once: sampling the
    ranges anew for a second consumer could place rows differently. ``(keys, order)`` must
    be unique, otherwise equal rows cannot be spread.
    """
    ranged = cut_lineage(df.repartitionByRange(*keys, *order), required=True)
    work = ranged.withColumn(_BLK, F.spark_partition_id().cast("bigint"))
    return scan_blocks(work, keys, order, scans, df.columns)


def scan_blocks(work: DataFrame, keys: list[str], order: list[str], scans: list[Running],
                keep: list[str], block: str = _BLK) -> DataFrame:
    """Scan over frames whose ``block`` column ascends with ``order`` inside each key."""
    if block != _BLK:
        work = work.withColumn(_BLK, F.col(block))
    group = [*keys, _BLK]
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    work = work.select(*keep, _BLK, *[s.value.alias(_value(i)) for i, s in enumerate(scans)])
    # one exchange feeds both the block totals and the local windows
    work = work.repartition(*group)

    totals = work.groupBy(*group).agg(
        *[_REDUCE[s.kind](F.col(_value(i)), rank).alias(_carry(i)) for i, s in enumerate(scans)])
    carry = _prefix_over_blocks(totals, keys, scans)

    span = Window.partitionBy(*group).orderBy(*order)
    upto = span.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = span.rowsBetween(Window.unboundedPreceding, -1)
    local = work.select(*work.columns, *[
        _OVER[s.kind](F.col(_value(i)), upto if s.inclusive else before).alias(f"__l{i}")
        for i, s in enumerate(scans)])
    joined = local.join(carry, group, "left")
    return joined.select(*keep, *[
        _COMBINE[s.kind](F.col(_carry(i)), F.col(f"__l{i}")).alias(s.name) for i, s in enumerate(scans)])


def _prefix_over_blocks(totals: DataFrame, keys: list[str], scans: list[Running]) -> DataFrame:
    """Aggregate of all earlier blocks for every ``(keys, block)`` that has one.

    Without keys the block axis itself is cut into superblocks, so the last, unsplit step
    sees one row per ``SUPERBLOCK`` blocks only.
    """
    if keys:
        past = Window.partitionBy(*keys).orderBy(_BLK)
        before = past.rowsBetween(Window.unboundedPreceding, -1)
        return (totals
                .select(*keys, _BLK, F.lag(_BLK).over(past).alias("__prev"),
                        *[_OVER[s.kind](F.col(_carry(i)), before).alias(_carry(i))
                          for i, s in enumerate(scans)])
                .where(F.col("__prev").isNotNull()).drop("__prev"))

    level = totals.withColumn(_SUP, F.floor(F.col(_BLK) / SUPERBLOCK).cast("bigint"))
    inner = Window.partitionBy(_SUP).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    outer = (Window.partitionBy(F.lit(0)).orderBy(_SUP)
             .rowsBetween(Window.unboundedPreceding, -1))
    tops = level.groupBy(_SUP).agg(
        *[_REDUCE[s.kind](F.col(_carry(i)), F.col(_BLK)).alias(f"__t{i}") for i, s in enumerate(scans)])
    tops = tops.select(_SUP, *[_OVER[s.kind](F.col(f"__t{i}"), outer).alias(f"__t{i}")
                               for i, s in enumerate(scans)])
    local = level.select(_SUP, _BLK, *[_OVER[s.kind](F.col(_carry(i)), inner).alias(_carry(i))
                                       for i, s in enumerate(scans)])
    return local.join(tops, _SUP).select(_BLK, *[
        _COMBINE[s.kind](F.col(f"__t{i}"), F.col(_carry(i))).alias(_carry(i))
        for i, s in enumerate(scans)])


def ordinal(df: DataFrame, keys: list[str], order: str, name: str = "rn",
            width: int = BLOCK_WIDTH) -> DataFrame:
    """1-based position of each row within its key (skew-safe ``row_number``)."""
    return keyed_scan(df, keys, order, [Running(name, F.lit(1).cast("bigint"))], width)


def dense_sequence(df: DataFrame, order: str, name: str = "n", width: int = SEQUENCE_WIDTH) -> DataFrame:
    """1-based global position by ``order`` without a single-task window over the rows."""
    return keyed_scan(df, [], order, [Running(name, F.lit(1).cast("bigint"))], width)


def time_islands(df: DataFrame, time: str, gap: int, keys: list[str] | None = None,
                 name: str = "island", width: int = 60_000_000) -> DataFrame:
    """Label rows with the start time of their island.

    A new island opens where the step from the previous time (of the same key) exceeds
    ``gap``. Works on distinct times, so repeated timestamps never pile up in one group.
    Inside a block of ``width`` time units (one minute of microseconds by default) only
    the first time needs a look at the previous block, which the block summaries give.
    """
    keys = keys or []
    group = [*keys, _BLK]
    times = (df.select(*keys, time).where(F.col(time).isNotNull()).distinct()
             .withColumn(_BLK, block_index(time, width)).repartition(*group))
    span = Window.partitionBy(*group).orderBy(time)
    step = F.col(time) - F.lag(time).over(span)
    opened = times.select(*group, time, F.when(step > gap, F.col(time)).alias("__open"))
    local = opened.select(*group, time, F.last("__open", ignorenulls=True).over(
        span.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__local"))

    blocks = opened.groupBy(*group).agg(F.min(time).alias("__first"), F.max(time).alias("__last"),
                                        F.max("__open").alias("__inner"))
    past = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_BLK)
    before = F.lag("__last").over(past)
    starts = blocks.withColumn("__start", F.when(
        before.isNull() | (F.col("__first") - before > gap), F.col("__first")))
    running = F.last(F.coalesce("__inner", "__start"), ignorenulls=True).over(
        past.rowsBetween(Window.unboundedPreceding, -1))
    carry = starts.select(*group, F.coalesce(F.col("__start"), running).alias("__carry"))
    labelled = local.join(carry, group).select(*keys, time, F.coalesce("__local", "__carry").alias(name))
    return df.join(labelled, [*keys, time], "left")
