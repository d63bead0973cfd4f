"""Allow-list of provider address ranges: containment join with precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.address import METADATA_ADDRESS, ipv4_number
from flowloom.session import stored

# fixed values: providers in order of precedence with the reason they are reported under,
# and the ranges that are not read from a published list
PROVIDERS = [("gcloud", "GCloud"), ("aws", "AWS"), ("ggen", "Google"), ("canonical", "Canonical"), ("suse", "SUSE")]
METADATA_REASON = "Meta"
STATIC_RANGES = [
    ("canonical", "185.125.188.0/22"),
    ("canonical", "91.189.88.0/21"),
    ("suse", "195.135.223.0/24"),
]

# Addresses per bucket, a power of two; a lookup meets one bucket, a text with the rank of each of its addresses.
BUCKET = 1 << 12
# Size up to which the lookup side is broadcast, in segments of SEGMENT_BYTES.
SEGMENT_BYTES = 40
BROADCAST_SEGMENTS = 1_000_000


def provider_rank(provider: Column) -> Column:
    ranked = F
    for i, (name, _) in enumerate(PROVIDERS):
        ranked = ranked.when(provider == name, F.lit(i + 1))
    return ranked


def reason_of(rank: Column) -> Column:
    """Reason text of a precedence rank; rank 0 is the metadata address."""
    return F.get(F.array(*[F.lit(r) for r in [METADATA_REASON, *[r for _, r in PROVIDERS]]]), rank)


def static_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATIC_RANGES, "provider string, cidr string")


def _networks(ranges: DataFrame) -> DataFrame:
    """Distinct networks, ``(length, first, last)`` with the best ``rank``; unreadable ones and unknown providers go.

    The same as ``network_bounds`` in steps: as one expression each use of a part would parse the text again.
    """
    parts, length = F.col("parts"), F.col("length")
    cut = ranges.select(F.split("cidr", "/").alias("parts"), provider_rank(F.col("provider")).alias("rank"))
    given = F.when(F.size(parts) == 1, F.lit(32)).otherwise(F.get(parts, F.lit(1)).try_cast("int"))
    read = cut.select("rank", F.when(F.size(parts) <= 2, given).alias("length"), F.get(parts, F.lit(0)).alias("address"))
    sized = read.select("rank", ipv4_number(F.col("address")).alias("number"), F.when(length.between(0, 32), length).alias("length")).select(
        "rank", "number", "length", F.pow(F.lit(2.0), F.lit(32) - length).cast("bigint").alias("size"))
    placed = sized.select("rank", "length", "size", (F.floor(F.col("number") / F.col("size")).cast("bigint") * F.col("size")).alias("first"))
    best = placed.groupBy("length", "first", (F.col("first") + F.col("size") - 1).alias("last")).agg(F.min("rank").alias("rank"))
    # filters on what is written parse nothing twice
    return stored(best).where("first is not null and last is not null and rank is not null")


def range_segments(ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Disjoint ``(bucket, lo, hi, rank)`` segments with the best rank covering each.

    Ranges are cut at bucket borders and at each other's ends. The ranks covering a
    segment are found by equality on (prefix length, masked address), one probe per
    length that occurs, never by comparing segments with ranges pairwise.
    """
    nets = _networks(ranges)
    # 33 at most
    lengths = [r["length"] for r in nets.select("length").distinct().collect()]
    pieces = (nets.select("first", "last", F.explode(F.sequence(
        F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket))).alias("bucket")))
    start = F.col("bucket") * bucket
    points = (pieces.select("bucket", F.explode(F.array(
        F.greatest("first", start), F.least(F.col("last") + 1, start + bucket))).alias("lo"))
        .where(F.col("lo") < start + bucket).distinct())
    following = F.lead("lo").over(Window.partitionBy("bucket").orderBy("lo"))
    segments = points.withColumn("hi", F.coalesce(following, start + bucket) - 1)

    by_prefix = nets.select("length", "first", "rank")
    probes = segments.select("bucket", "lo", "hi", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("length"))
    size = F.pow(F.lit(2.0), F.lit(32) - F.col("length")).cast("bigint")
    probes = probes.withColumn("first", F.floor(F.col("lo") / size).cast("bigint") * size)
    return (probes.join(by_prefix, ["length", "first"])
            .groupBy("bucket", "lo", "hi").agg(F.min("rank").alias("rank")))


def bucket_rows(segments: DataFrame) -> DataFrame:
    """One row per bucket with its segments in ascending order, at most ``BUCKET`` of them."""
    ordered = F.sort_array(F.collect_list(F.struct("lo", "hi", "rank")))
    rows = segments.groupBy("bucket").agg(ordered.alias("s"))
    return rows.select("bucket", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), F.col("s.rank").alias("rank"))


def rank_texts(segments: DataFrame) -> DataFrame:
    """One row per bucket with a character per address, ``0`` plus its rank or a blank; a single one where all are alike."""
    ordered = F.sort_array(F.collect_list(F.struct("lo", "hi", "rank")))
    rows = segments.groupBy("bucket").agg(ordered.alias("s"))
    gap = f"x.lo - if(i = 0, bucket * {BUCKET}, get(s, i - 1).hi + 1)"
    runs = (f"transform(s, (x, i) -> concat(repeat(' ', cast({gap} as int)), "
            "repeat(char(48 + x.rank), cast(x.hi - x.lo + 1 as int))))")
    texts = rows.select("bucket", F.rpad(F.array_join(F.expr(runs), ""), BUCKET, " ").alias("ranks"))
    first = F.substring("ranks", 1, 1)
    alike = F.col("ranks") == F.repeat(first, F.lit(BUCKET))
    return texts.select("bucket", F.when(alike, F.lit(1)).otherwise(BUCKET).alias("width"),
                        F.when(alike, first).otherwise(F.col("ranks")).cast("binary").alias("ranks"))


def _lookup(df: DataFrame, address: str, texts: DataFrame, name: str) -> DataFrame:
    # a bucket is one row, so the left join keeps one row per flow
    number, key, width, ranks = [f"__{n}_{name}" for n in ("n", "b", "width", "ranks")]
    side = texts.select(F.col("bucket").alias(key), F.col("width").alias(width), F.col("ranks").alias(ranks))
    joined = df.withColumn(number, ipv4_number(F.col(address))).join(side, F.floor(F.col(number) / BUCKET) == F.col(key), "left")
    code = F.ascii(F.substring(F.col(ranks), (F.col(number) % F.col(width) + 1).cast("int"), F.lit(1)).cast("string"))
    return joined.select(*df.columns, F.when(code >= 48, code - 48).alias(name))


def allow_reason(df: DataFrame, ranges: DataFrame, saddr: str = "saddr", daddr: str = "daddr",
                 name: str = "reason", broadcast_limit: int = BROADCAST_SEGMENTS) -> DataFrame:
    """Add the reason a flow is exempt: best provider holding its source or destination.

    The buckets are built once; they are broadcast only if their size is within
    ``broadcast_limit`` and joined by shuffle (with skew splitting) beyond it. A flow meets one
    row, its bucket, and reads the rank at its place there.
    """
    texts = stored(rank_texts(range_segments(ranges)))
    size = texts.agg(F.coalesce(F.sum(F.ceil(F.col("width") / SEGMENT_BYTES)), F.lit(0))).first()[0]
    side = F.broadcast(texts) if size <= broadcast_limit else texts
    found = _lookup(_lookup(df, saddr, side, "__src_rank"), daddr, side, "__dst_rank")
    meta = (F.col(saddr) == METADATA_ADDRESS) | (F.col(daddr) == METADATA_ADDRESS)
    rank = F.when(meta, F.lit(0)).otherwise(F.least("__src_rank", "__dst_rank"))
    return found.withColumn(name, reason_of(rank)).drop("__src_rank", "__dst_rank")
