"""Helpers shared by the corpus operators: shared folders, text expressions, word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import checkpoint_root

# White space and words as every operator here reads them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Whether Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def workspace(spark: SparkSession) -> str:
    """A new folder under the shared folder of the cluster for what one call writes.

    The folder is left in place, since the frames that a call returns read it; its owner may
    delete it once the result is written.
    """
    root = checkpoint_root(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet into ``folder`` and read it back: cuts lineage, survives lost executors.

    Later steps read the table only, so the shuffle files of the write go at its end and do not
    wait for the driver's garbage collection.
    """
    path, conf = f"{folder}/{name}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete intermediates of ``folder`` whose only readers are written."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole(text: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_group_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, n_rows: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which holds each of their groups once with its ``count`` of rows.

    A group above an even share of one task would be one key of the join. There are fewer of
    them than tasks, so their facts are broadcast; all others meet by key.
    """
    share = max(1, -(-n_rows // partitions(rows.sparkSession)))
    hot = F.broadcast(facts.where(F.col(count) > share))
    return rows.join(hot, keys).unionByName(
        rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(F.col(count) <= share), keys))
