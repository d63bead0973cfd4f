"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source's target gives whole passes over
it and a remaining budget; the budget is filled in proportion over all lengths first, and a
bounded-knapsack programme over the length counts fits the last words. Which documents of a
length are taken follows a seeded hash, ranked inside hash blocks, so one source and length
with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import WORD, whole, workspace, written
from flowloom.operators.scan import Running, sorted_scan

WEIGHTS = (5, 2, 1)
# Words fitted exactly by the knapsack programme; what lies above is filled in proportion.
EXACT_WORDS = 1 << 14
HASH_BLOCKS = 1 << 10


def source_targets(sizes: DataFrame, folder: str, weights=WEIGHTS, share: float = 1.0, cap: int = 3) -> DataFrame:
    """``(source, source_size, target)``: weighted shares of all words, at most ``cap`` times a source's own.

    Weights repeat over the sources in code point order, null last. What exceeds a cap is shared
    again by weight until no source is above: the water level is lowered or raised by one
    aggregate a step, and each step caps one more source at least.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    keyed = sums.select("*", F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name"))
    ranked = sorted_scan(keyed, [], ["last", "name"], [Running("rn", F.lit(1).cast("bigint"))])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", "docs", weight.alias("weight")), folder, "sources")
    most = F.col("source_size") * float(cap)
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * float(total or 0)
    level, capped_before = (budget / all_weights if all_weights else 0.0), -1
    while True:
        above = most <= F.col("weight") * F.lit(level)
        full, rest, capped = ranked.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight"))),
                                        F.count(F.when(above, 1))).first()
        if capped == capped_before or not rest:
            break
        level, capped_before = (budget - (full or 0.0)) / rest, capped
    return ranked.select("source", "source_size", F.least(most, F.col("weight") * F.lit(level)).alias("target"))


def fit_counts(lengths: list[int], counts: list[int], budget: int, exact: int = EXACT_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come to ``budget``, or next to it.

    Bounded knapsack over length counts: above ``exact`` words every length gives its
    proportional part, then the longest lengths that still fit; the rest is solved exactly on
    sets of reachable sums, kept as the bits of integers.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    taken = [0] * len(lengths)
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return list(counts)
    left = budget
    if left > exact:
        taken = [c * budget // total for c in counts]
        left -= sum(n * k for n, k in zip(lengths, taken))
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            if left <= exact:
                break
            if lengths[i]:
                more = min(counts[i] - taken[i], (left - exact // 2) // lengths[i])
                taken[i] += more
                left -= more * lengths[i]
    reach, steps, mask = 1, [], (1 << (2 * left + 1)) - 1
    for i in sorted((i for i in range(len(lengths)) if 0 < lengths[i] <= 2 * left), key=lambda i: lengths[i]):
        if reach >> left & 1:
            break
        free, part = min(counts[i] - taken[i], 2 * left // lengths[i]), 1
        while free:
            part = min(part, free)
            steps.append((i, part, reach))
            reach |= reach << part * lengths[i] & mask
            free, part = free - part, part * 2
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    higher = reach >> (left + 1)
    above = left + (higher & -higher).bit_length() if higher else None
    at = above if above is not None and above - left < left - below else below
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * lengths[i]
    return taken


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    lengths, counts = [int(x) for x in group["size"]], [int(x) for x in group["n"]]
    source_size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    passes = math.floor(target / source_size) if source_size else 0
    group["passes"] = passes
    group["extra"] = fit_counts(lengths, counts, round(target) - passes * source_size)
    return group[["source", "size", "source_size", "target", "passes", "extra"]]


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: int = 3, seed: int = 17,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` is the number of words (null text: none), ``copies`` how often the mix repeats the
    document, ``taken`` the words that makes. Reruns agree; rows that repeat an id are ranked as
    one block of equal rows, of which any may be taken. Empty texts are taken with no words. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = workspace(spark)
    sizes = written(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(whole(text_col), F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))
        .withColumn("block", F.pmod("h", F.lit(HASH_BLOCKS)).cast("int")), folder, "sizes")
    targets = source_targets(sizes, folder, weights, share, cap)

    blocks = sizes.groupBy("source", "size", "block").agg(F.count(F.lit(1)).alias("n"))
    lengths = blocks.groupBy("source", "size").agg(F.sum("n").alias("n"))
    t = targets.withColumnRenamed("source", "of")
    plan = (lengths.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
            .groupBy("source").applyInPandas(_plan, "source string, size bigint, source_size bigint, "
                                             "target double, passes bigint, extra bigint"))
    p = written(plan, folder, "plan").withColumnRenamed("source", "of").withColumnRenamed("size", "long")
    upto = Window.partitionBy("source", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
              .join(p, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("long")))
              .select(F.col("of"), F.col("long"), F.col("block").alias("part"), "before", "source_size", "target",
                      "passes", "extra"))
    inside = Window.partitionBy("source", "size", "block").orderBy("h", "id")
    ranked = sizes.withColumn("nth", F.row_number().over(inside))
    out = ranked.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("long"))
                      & (F.col("block") == F.col("part")))
    copies = F.col("passes") + F.when(F.col("before") + F.col("nth") <= F.col("extra"), 1).otherwise(0)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target",
                      copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns as they were.

    Rows that repeat an id are all taken as often as the one that is taken most; rows with a
    null id are taken as often as the null ids' most.
    """
    copies = (mix_sources(docs, id_col=id_col, **options).groupBy(F.col(id_col).alias("of"))
              .agg(F.max("copies").alias("copies")).where(F.col("copies") > 0))
    repeated = docs.join(copies, F.col(id_col).eqNullSafe(F.col("of"))).select(
        F.struct(*docs.columns).alias("row"), F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")
