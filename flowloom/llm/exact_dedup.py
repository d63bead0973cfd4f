"""Exact deduplication through an extendible-hash index on shared files.

The key of a text is a 64-bit hash of its normalised form. The directory maps the leading
bits of a key to a bucket; a bucket that would hold more keys than its capacity is split by
one more bit, which doubles the directory where needed. Each owner task processes a range of
buckets: it sorts its entries, chains texts whose keys collide, and compares their bytes.
A key with more rows than an even share of one owner (a group of copies may hold a third of
the table) is salted over several owners, whose local results are then merged. Everything is
DataFrame code; keys, directory and index are Parquet tables in the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import SPACE, partitions, whole, workspace, written

# A bucket is split beyond so many keys ...
BUCKET_KEYS = 256
# ... or beyond this share of all keys, which bounds the directory at 2 ** (MAX_SPLITS + 3) slots.
MAX_SPLITS = 12


def directory(keys: DataFrame, n_keys: int, owners: int, chunk: int, bucket_keys: int = BUCKET_KEYS):
    """``(slot, bucket, depth, owner)`` for every used slot, and the number of leading bits of a slot.

    Splitting one bit at a time until no bucket is overfull gives each slot the shortest
    prefix of its bits with at most ``capacity`` keys, so all depths are counted at once.
    Equal keys cannot be split: a bucket at the greatest depth may stay overfull, which costs
    time and changes no result.
    """
    capacity = max(bucket_keys, math.ceil(n_keys / (1 << MAX_SPLITS)))
    bits = max(1, math.ceil(math.log2(max(1, n_keys / capacity)))) + 3
    cells = (keys.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("slot"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("rows", F.lit(chunk))).alias("load")))
    ladder = (cells.select("slot", "n", "load", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
              .groupBy("depth", F.expr(f"shiftright(slot, {bits} - depth)").alias("prefix"))
              .agg(F.sum("n").alias("n"), F.sum("load").alias("load")))
    parent = ladder.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    split = ladder.withColumn("up", F.shiftright("prefix", 1)).join(parent, ["depth", "up"], "left_semi")
    buckets = (split.select("depth", "prefix", "n", "load").union(
        ladder.where(F.col("depth") == 0).select("depth", "prefix", "n", "load"))
        .where((F.col("n") <= capacity) | (F.col("depth") == bits))
        .withColumn("first", F.expr(f"shiftleft(prefix, {bits} - depth)"))
        .withColumn("last", F.expr(f"shiftleft(prefix + 1, {bits} - depth) - 1")))
    # at most 2 ** (MAX_SPLITS + 3) rows, whatever the input
    before = F.sum("load").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("load").over(Window.partitionBy())
    owned = buckets.select("depth", "first", "last", F.least(F.lit(owners - 1), F.floor(
        (before - F.col("load") / 2) * owners / total)).cast("int").alias("owner"))
    return owned.select(F.explode(F.sequence("first", "last")).alias("slot"), F.col("first").alias("bucket"),
                        "depth", "owner"), bits


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bucket_keys: int = BUCKET_KEYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_bytes``.

    Texts are equal when they agree byte by byte after each run of white space became one
    space. Null text is the empty text. The row with the smallest id stays; null ids come
    last, and of rows that repeat id and text one stays. An empty table gives no rows. Only
    the two columns are read, so other columns may have any name; those in ``carry`` come along
    in a struct column ``carried``.
    """
    spark = docs.sparkSession
    folder = workspace(spark)
    owners = partitions(spark)
    text = F.regexp_replace(whole(text_col), SPACE, " ")
    extra = [F.struct(*carry).alias("carried")] if carry else []
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), *extra).withColumn("h", F.xxhash64("text"))
    along = ["carried"] if carry else []

    keys = written(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("rows")), folder, "keys")
    n_keys, n_rows = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    chunk = max(1, math.ceil(n_rows / owners))
    slots, bits = directory(keys, n_keys, owners, chunk, bucket_keys)
    slots = written(slots, folder, "directory")
    # keys above an even share: fewer than owners
    hot = keys.where(F.col("rows") > chunk).select("h", F.ceil(F.col("rows") / chunk).cast("int").alias("salts"))

    dealt = (keyed.withColumn("slot", F.shiftrightunsigned("h", 64 - bits))
             .join(F.broadcast(slots), "slot").join(F.broadcast(hot), "h", "left")
             .withColumn("owner", F.pmod(F.col("owner") + F.coalesce(
                 F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)), F.lit(owners)).cast("int"))
             .select("id", "text", *along, "h", "bucket", "salts", "owner").repartitionById(owners, "owner"))
    same = Window.partitionBy("owner", "h", "text")
    chained = dealt.select("*", F.row_number().over(same.orderBy(F.col("id").asc_nulls_last())).alias("nth"))
    index = written(chained.select(
        *along, "owner", "bucket", "h", "id", "nth", "salts", F.sha2("text", 256).alias("sha"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.min("id").over(same).alias("keep"), F.count(F.lit(1)).over(same).alias("size")), folder, "index")

    # salted keys: as many rows as there are hot texts, fewer than owners
    merged = (index.where(F.col("salts").isNotNull()).groupBy("h", "sha", "n_bytes")
              .agg(F.min("id").alias("all_keep"), F.count(F.lit(1)).alias("all_size")))
    out = index.join(F.broadcast(merged), ["h", "sha", "n_bytes"], "left").select(
        "id", "nth", F.coalesce("all_keep", "keep").alias("keep"), F.coalesce("all_size", "size").alias("size"),
        "sha", "n_bytes", *along)
    return out.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        ((F.col("nth") == 1) & F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"), "n_bytes", *along)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, all columns as they were."""
    found = exact_dedup(docs, id_col, text_col, carry=tuple(docs.columns))
    return found.where("kept").select("carried.*")
