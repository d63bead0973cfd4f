"""Profiling of flow tables: value counts, descriptive and sentinel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.coerce import double_of
from flowloom.operators.scan import Running, sorted_scan
from flowloom.schemas import SHORT_FLOW_FEATURES
from flowloom.session import cut_lineage

# fixed values: reported percentiles and the longest "short" flow
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
MAX_SHORT_PACKETS = 3
# Bins that the values between a number and its double are counted in.
OCTAVE_BINS = 64


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts per value, missing included, for several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return (df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))


def ranked_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Value counts, most frequent first."""
    return value_counts(df, cols).orderBy("column", F.desc("count"), "value")


def has_value(df: DataFrame, column: str, value) -> DataFrame:
    """One row: does ``value`` occur in ``column``?"""
    return df.agg(F.coalesce(F.bool_or(F.col(column) == value), F.lit(False)).alias("present"))


def label_shares(df: DataFrame, label: str = "label") -> DataFrame:
    """Totals and percentages of attack and normal rows; percentages are 0 on empty input."""
    attacks, normals = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    total = F.count(F.lit(1))

    def percent(part):
        return F.coalesce(F.lit(100.0) * part / F.nullif(total, F.lit(0)), F.lit(0.0))
    return df.agg(total.alias("total"), attacks.alias("attacks"), normals.alias("normals"),
                  percent(attacks).alias("attack_pct"), percent(normals).alias("normal_pct"))


def long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) rows of the listed columns that exist, leniently cast to double."""
    kinds = dict(df.dtypes)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), double_of(c, kinds[c]).alias("value"))
                      for c in cols if c in kinds])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def _bin(v: Column) -> Column:
    """Number of the stretch of values that ``v`` lies in; it never falls while ``v`` rises."""
    size = F.floor(F.least(F.log2(F.abs(v)) * OCTAVE_BINS, F.lit(1e6))) + F.lit(1e6)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * size)


def exact_quantiles(values: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value") -> DataFrame:
    """Linearly interpolated quantiles per ``keys``, exact at any size.

    A first scan counts the values of each bin, a fixed part of an octave, so that what it shuffles is bounded by the
    number of bins and not by that of values. A second scan keeps only values of the bins that hold a wanted rank:
    equal ones are counted, distinct ones range partitioned and their counts accumulated on top of the values of lower
    bins. No task ever holds a whole column.
    """
    v, known = F.col(value), values.where(F.col(value).isNotNull())
    binned = known.select(*keys, v, _bin(v).alias("__bin"))
    counts = binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__cnt"))
    # one row per bin of a group
    group = Window.partitionBy(*keys)
    upto = counts.withColumns({"__cum": F.sum("__cnt").over(group.orderBy("__bin")), "__n": F.sum("__cnt").over(group)})
    ranks = F.array(*[F.struct(
        F.lit(k).alias("name"), F.floor(F.lit(p) * (F.col("__n") - 1)).alias("low"), F.ceil(F.lit(p) * (F.col("__n") - 1)).alias("high"),
        (F.lit(p) * (F.col("__n") - 1) - F.floor(F.lit(p) * (F.col("__n") - 1))).alias("frac")) for k, p in probs.items()])

    def covers(rank: Column, cum: Column, cnt: str) -> Column:
        return (rank >= cum - F.col(cnt)) & (rank < cum)
    wanted = F.filter(ranks, lambda t: covers(t["low"], F.col("__cum"), "__cnt") | covers(t["high"], F.col("__cum"), "__cnt"))
    # at most two bins per quantile and reported group (columns, packet counts): bounded by what the caller names
    bins = cut_lineage(upto.select(*keys, "__bin", (F.col("__cum") - F.col("__cnt")).alias("__below"), wanted.alias("__t"))
                       .where(F.size("__t") > 0))
    # range partitioning reads its input twice
    inside = cut_lineage(binned.join(F.broadcast(bins.select(*keys, "__bin")), [*keys, "__bin"])
                         .groupBy(*keys, "__bin", value).agg(F.count(F.lit(1)).alias("__eq")))
    placed = sorted_scan(inside, [*keys, "__bin"], [value], [Running("__run", F.col("__eq"))])
    last = F.col("__below") + F.col("__run")
    hits = (placed.join(F.broadcast(bins), [*keys, "__bin"]).withColumn("__last", last)
            .select(*keys, value, "__last", "__eq", F.explode("__t").alias("t")))

    def held(rank: str) -> Column:
        return F.max(F.when(covers(F.col(rank), F.col("__last"), "__eq"), v))
    ends = hits.groupBy(*keys, F.col("t.name").alias("__name")).agg(
        held("t.low").alias("lo"), held("t.high").alias("hi"), F.max("t.frac").alias("__frac"))
    return (ends.withColumn("__q", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("__frac"))
            .groupBy(*keys).pivot("__name", list(probs)).agg(F.max("__q")))


def approximate_quantiles(values: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value",
                          accuracy: int = 10_000) -> DataFrame:
    """Quantiles by a mergeable sketch: one pass, bounded memory, rank error 1/accuracy."""
    names = list(probs)
    sketch = values.groupBy(*keys).agg(
        F.percentile_approx(value, [probs[k] for k in names], accuracy).alias("__q"))
    return sketch.select(*keys, *[F.col("__q")[i].alias(k) for i, k in enumerate(names)])


def _moments(value: str = "value") -> list[Column]:
    v = F.col(value)
    return [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max")]


def _sentinels(value: str = "value") -> list[Column]:
    v = F.col(value)
    return [F.count_if(v == 0).alias("zeros"), F.count_if(v == -1).alias("minus_ones"),
            F.count_if(v.isNull()).alias("nulls")]


def sentinel_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zeros, -1 and missing values per column: counts and percentages."""
    counts = long_form(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("rows"), *_sentinels())
    return counts.select("column", *[
        c for n in ("zeros", "minus_ones", "nulls")
        for c in (F.col(n), (F.lit(100.0) * F.col(n) / F.col("rows")).alias(f"{n}_pct"))])


def describe(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Count, mean, deviation, extremes and percentiles, one row per column."""
    values = long_form(df, cols)
    quantiles = approximate_quantiles if approx else exact_quantiles
    moments = values.groupBy("column").agg(*_moments())
    return moments.join(quantiles(values, ["column"], PERCENTILES), "column", "left")


def full_profile(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Descriptive and sentinel statistics side by side."""
    values = long_form(df, cols)
    quantiles = approximate_quantiles if approx else exact_quantiles
    measured = values.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), *_moments(), *_sentinels())
    return (measured.join(quantiles(values, ["column"], PERCENTILES), "column", "left")
            .select("column", "count", "mean", "std", "min", "max", *PERCENTILES, *[
                c for n in ("zeros", "minus_ones", "nulls")
                for c in (F.col(n), (F.lit(100.0) * F.col(n) / F.col("rows")).alias(f"{n}_pct"))]))


def short_flow_stats(df: DataFrame, features: dict[str, str] | None = None,
                     max_packets: int = MAX_SHORT_PACKETS, approx: bool = False) -> DataFrame:
    """Statistics of jitter and spacing for flows of exactly 1..max_packets packets.

    Combinations without any flow are listed with size 0.
    """
    features = features or SHORT_FLOW_FEATURES
    features = {f: p for f, p in features.items() if f in df.columns and p in df.columns}
    keys, kinds = ["feature", "packet_column", "packets"], dict(df.dtypes)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(p).alias("packet_column"),
                               double_of(p, kinds[p]).cast("int").alias("packets"),
                               double_of(f, kinds[f]).alias("value")) for f, p in features.items()])
    # keep whole packet counts only: 1.5 packets is no group
    exact = F.array(*[double_of(p, kinds[p]).isin(*range(1, max_packets + 1)) for p in features.values()])
    values = (df.select(F.explode(F.arrays_zip(pairs.alias("p"), exact.alias("keep"))).alias("z"))
              .where("z.keep").select("z.p.*"))
    quantiles = approximate_quantiles if approx else exact_quantiles
    measured = (values.groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("flows"), *_moments()[1:], *_sentinels())
                .join(quantiles(values, keys, QUARTILES), keys, "left"))
    grid = df.sparkSession.createDataFrame(
        [(f, p, n) for f, p in features.items() for n in range(1, max_packets + 1)],
        "feature string, packet_column string, packets int")
    zero = F.lit(0).cast("bigint")
    return measured.join(grid, keys, "right").select(
        *keys, F.coalesce("flows", zero).alias("flows"), "mean", "std", "min", "max", *QUARTILES,
        *[F.coalesce(n, zero).alias(n) for n in ("zeros", "minus_ones", "nulls")])
