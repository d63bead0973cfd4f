"""Recent-history counters over the merged flow sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.enrich import NO_SERVICE
from flowloom.operators.scan import SEQUENCE_WIDTH, dense_sequence

HISTORY = 100
HISTORY_BLOCK = 1 << 13

# Counter name -> columns that must agree. Counters on the service compare through
# ``__service`` and count ``service`` itself, so rows without one look for "-" but are
# never found by others.
COUNTERS = {
    "ct_srv_src": ["__service", "saddr"],
    "ct_srv_dst": ["__service", "daddr"],
    "ct_dst_ltm": ["daddr"],
    "ct_src_ltm": ["saddr"],
    "ct_src_dport_ltm": ["saddr", "dport"],
    "ct_dst_sport_ltm": ["daddr", "sport"],
    "ct_dst_src_ltm": ["saddr", "daddr"],
}

_BLK = "__hist_blk"


def with_history_blocks(df: DataFrame, n: str, history: int = HISTORY,
                        block: int = HISTORY_BLOCK) -> DataFrame:
    """Cut the sequence into blocks, each preceded by the rows its first frames need.

    The last ``history`` rows of a block are repeated as context (``__own`` false) of the
    next one. One exchange by block then serves every counter, and blocks are equally
    large no matter how skewed addresses or services are.
    """
    if block < history:
        raise ValueError("block must be at least as long as the history")
    home = F.floor(F.col(n) / F.lit(block)).cast("bigint")
    late = F.pmod(F.col(n), F.lit(block)) >= block - history
    return (df.withColumn("__home", home)
            .withColumn(_BLK, F.explode(F.when(late, F.array("__home", F.col("__home") + 1))
                                        .otherwise(F.array("__home"))))
            .withColumn("__own", F.col("__home") == F.col(_BLK))
            .drop("__home")
            .repartition(_BLK))


def history_count(counted: Column, keys: list[str], n: str, history: int = HISTORY) -> Column:
    frame = Window.partitionBy(_BLK, *keys).orderBy(n).rangeBetween(-history, -1)
    return F.count(counted).over(frame)


def without_history_blocks(df: DataFrame) -> DataFrame:
    return df.where("__own").drop(_BLK, "__own")


def connection_counters(df: DataFrame, n: str = "n", same_second: bool = True,
                        history: int = HISTORY, block: int = HISTORY_BLOCK) -> DataFrame:
    """Seven counters over the previous ``history`` rows of the dense sequence ``n``.

    ``same_second`` adds the end second ``ltime`` to every comparison; the variant
    without it compares addresses, ports and service alone.
    """
    blocked = with_history_blocks(df.withColumn("__service", F.coalesce("service", F.lit(NO_SERVICE))),
                                  n, history, block)
    suffix = ["ltime"] if same_second else []
    counted = blocked.select(*blocked.columns, *[
        history_count(F.col("service") if "__service" in keys else F.lit(1), [*keys, *suffix], n, history)
        .alias(name)
        for name, keys in COUNTERS.items()])
    return without_history_blocks(counted).drop("__service")


def last_n_count(df: DataFrame, order: str, keys: list[Column], name: str, where: Column,
                 history: int = HISTORY, block: int = HISTORY_BLOCK,
                 width: int = SEQUENCE_WIDTH) -> DataFrame:
    """Rows equal on ``keys`` among the previous ``history`` rows that satisfy ``where``.

    Only rows satisfying ``where`` enter the history; all others get 0.
    """
    hit = F.coalesce(where, F.lit(False))
    inside = dense_sequence(df.where(hit), order, "__n", width)
    named = [f"__k{i}" for i in range(len(keys))]
    blocked = with_history_blocks(inside.select(*inside.columns, *[k.alias(a) for k, a in zip(keys, named)]),
                                  "__n", history, block)
    counted = without_history_blocks(
        blocked.withColumn(name, history_count(F.lit(1), named, "__n", history)))
    return (counted.select(*df.columns, name)
            .unionByName(df.where(~hit).withColumn(name, F.lit(0).cast("bigint"))))
