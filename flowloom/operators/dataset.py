"""Preparation of labelled tables: union, projection, balancing, splits and folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.coerce import label_int, require_columns
from flowloom.operators.scan import Running, scan_blocks
from flowloom.schemas import CANONICAL_NAMES, LABELLED_FIELDS

SEED = 42
# Leading hex digits of the sampling hash that form a block: 16**5 even blocks.
HASH_DIGITS = 5


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename drifting column names to the canonical ones."""
    present = set(df.columns)
    return df.withColumnsRenamed({a: b for a, b in CANONICAL_NAMES.items() if a in present and b not in present})


def ordered_projection(df: DataFrame, keep: list[str], order: list[str] | None = None) -> DataFrame:
    """Columns that are wanted and exist, in declared order."""
    wanted, present = set(keep), set(df.columns)
    return df.select(*[c for c in (order or LABELLED_FIELDS) if c in wanted and c in present])


def positional_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the first one's column names, duplicates kept."""
    return reduce(DataFrame.union, frames)


def valid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows labelled 0 or 1 after coercion."""
    return df.withColumn(label, label_int(F.col(label))).where(F.col(label).isin(0, 1))


def sampling_hash(row_id: str | Column, seed: int = SEED) -> Column:
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))


def _hash_block(h: str) -> Column:
    return F.conv(F.substring(h, 1, HASH_DIGITS), 16, 10).cast("bigint")


def seeded_order(df: DataFrame, row_id: str, seed: int = SEED) -> DataFrame:
    """All rows in a random order fixed by the seed (distributed sort)."""
    return df.orderBy(sampling_hash(row_id, seed), row_id)


def class_rank(df: DataFrame, label: str, row_id: str, seed: int = SEED, name: str = "rank") -> DataFrame:
    """1-based position of a row within its class in hash order.

    The hash is uniform, so its leading digits cut even one dominating class into equal
    blocks. ``row_id`` must be unique.
    """
    hashed = df.withColumn("__h", sampling_hash(row_id, seed)).withColumn("__b", _hash_block("__h"))
    return scan_blocks(hashed, [label], ["__h", row_id], [Running(name, F.lit(1).cast("bigint"))],
                       [*df.columns, "__h"], block="__b").drop("__h")


class NotEnoughRows(ValueError):
    """A class holds fewer rows than the sample asks for."""


def class_sizes(df: DataFrame, label: str = "label") -> dict[int, int]:
    row = df.agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("n")).first()
    return {1: row["a"], 0: row["n"]}


def exact_sample(df: DataFrame, sizes: dict[int, int], label: str, row_id: str, seed: int = SEED) -> DataFrame:
    """Exactly ``sizes[class]`` rows per class, the first in hash order.

    Counts per hash block find the block in which a class reaches its size. Earlier blocks
    are taken by a plain filter; only that one block is ranked, so neither a global limit
    nor a class-wide window is needed.
    """
    hashed = df.withColumn("__h", sampling_hash(row_id, seed)).withColumn("__b", _hash_block("__h"))
    want = reduce(lambda c, kv: c.when(F.col(label) == kv[0], F.lit(kv[1])), sizes.items(), F).cast("bigint")
    # at most classes * 16**HASH_DIGITS rows
    blocks = hashed.where(want.isNotNull()).groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    earlier = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cut = (blocks.withColumn("__before", F.coalesce(F.sum("__cnt").over(earlier), F.lit(0)))
           .withColumn("__want", want)
           .where((F.col("__before") < F.col("__want")) & (F.col("__before") + F.col("__cnt") >= F.col("__want")))
           .select(label, F.col("__b").alias("__edge"), (F.col("__want") - F.col("__before")).alias("__rest")))
    # one row per class by construction
    placed = hashed.join(F.broadcast(cut), label)
    inside = placed.where(F.col("__b") < F.col("__edge"))
    edge = (placed.where(F.col("__b") == F.col("__edge"))
            .withColumn("__rn", F.row_number().over(Window.partitionBy(label).orderBy("__h", row_id)))
            .where(F.col("__rn") <= F.col("__rest")).drop("__rn"))
    return inside.unionByName(edge).select(*df.columns)


def balance(df: DataFrame, n_pos: int | None = None, ratio: int = 3, label: str = "label", row_id: str = "seq",
            seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """Class-balanced sample: ``n_pos`` attacks and ``ratio`` times as many normal rows.

    Refuses when a class is too small. Without ``n_pos`` the largest feasible size is used.
    """
    if columns is not None:
        df = require_columns(df, list(dict.fromkeys([*columns, row_id])))
    rows = valid_labels(df, label)
    have = class_sizes(rows, label)
    if n_pos is None:
        n_pos = min(have[1], have[0] // ratio)
    sizes = {1: n_pos, 0: n_pos * ratio}
    short = {k: (have[k], v) for k, v in sizes.items() if have[k] < v}
    if short:
        raise NotEnoughRows(f"class: (available, wanted) = {short}")
    return exact_sample(rows, sizes, label, row_id, seed)


def hash_split(df: DataFrame, row_id: str, train_share: float = 0.8, seed: int = SEED,
               name: str = "is_train") -> DataFrame:
    """Train/test flag that depends on the row alone, not on partitioning."""
    bucket = F.conv(F.substring(sampling_hash(row_id, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(name, bucket < F.lit(int(train_share * (1 << 32))))


def stratified_folds(df: DataFrame, label: str, row_id: str, folds: int = 15, seed: int = SEED,
                     name: str = "fold") -> DataFrame:
    """Fold number with every class spread evenly over the folds."""
    ranked = class_rank(df, label, row_id, seed, "__rank")
    return ranked.withColumn(name, F.pmod(F.col("__rank") - 1, F.lit(folds)).cast("int")).drop("__rank")
