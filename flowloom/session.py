"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call-site capture costs several JVM round trips per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "flowloom", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Shared folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. ``fallback`` is used only where
    that is unset, as in tests.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or known or fallback
    if root and not known:
        context.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame, required: bool = False) -> DataFrame:
    """Write an intermediate once instead of recomputing it for every consumer.

    Uses a reliable checkpoint in the shared folder, so it outlives lost executors.
    Where no folder is configured the frame is returned as it is, unless the caller
    depends on the partitions staying as they are (``required``).
    """
    if checkpoint_root(df.sparkSession):
        return df.checkpoint()
    if required:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return df


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, written as Parquet: the last stage of ``df`` runs once, a reliable checkpoint runs it twice.

    For rows that may be dealt anew when they are read. Columns without a type cannot be written as Parquet.
    """
    root = checkpoint_root(df.sparkSession)
    if not root or any(kind == "void" for _, kind in df.dtypes):
        return cut_lineage(df)
    path = f"{root.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
