"""Last-100 counters across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.history import HISTORY, connection_counters
from flowloom.operators.scan import Running, dense_sequence, sorted_scan

_NEEDED = ["merge_seq", "service", "saddr", "sport", "daddr", "dport", "ltime"]


class HistoryBatches:
    """``foreachBatch`` sink that continues the counters from batch to batch.

    Each batch reads the tail (last 100 rows) its predecessor stored, counts, and writes
    its rows and its own tail under its batch id. A repeated batch overwrites exactly what
    it wrote before.

    History runs in the order of emission: by batch, and by ``merge_seq`` inside a batch. A
    merge that becomes complete late follows those emitted before it, as in the live loop.
    Rows that expired without a partner are no merges: they go to ``unmatched`` and are not
    counted.
    """

    def __init__(self, path: str, same_second: bool = True):
        self.staged = f"{path}/staged"
        self.rows = f"{path}/rows"
        self.tails = f"{path}/tails"
        self.unmatched = f"{path}/unmatched"
        self.same_second = same_second

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # written once: several steps read it, and a stateful plan must not run for each of them
        staged = f"{self.staged}/{batch_id}"
        batch.write.mode("overwrite").parquet(staged)
        batch = spark.read.schema(batch.schema).parquet(staged)
        if "status" in batch.columns:
            lost = batch.where(F.col("status") != "merged")
            lost.write.mode("overwrite").parquet(f"{self.unmatched}/batch={batch_id}")
            batch = batch.where(F.col("status") == "merged")
        rows = (dense_sequence(batch, "merge_seq", "n") if batch.schema["merge_seq"].dataType == T.LongType()
                else sorted_scan(batch, [], ["merge_seq"], [Running("n", F.lit(1).cast("bigint"))]))
        tail, start = None, 0
        if batch_id > 0:
            tail = spark.read.parquet(f"{self.tails}/{batch_id - 1}")
            start = tail.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        rows = rows.withColumn("n", F.col("n") + F.lit(start)).withColumn("__new", F.lit(True))
        history = rows if tail is None else rows.unionByName(
            tail.withColumn("__new", F.lit(False)), allowMissingColumns=True)
        counted = connection_counters(history, "n", self.same_second)
        (counted.where("__new").drop("__new").write.mode("overwrite")
         .parquet(f"{self.rows}/batch={batch_id}"))
        (history.select(*_NEEDED, "n").orderBy(F.desc("n")).limit(HISTORY)
         .write.mode("overwrite").parquet(f"{self.tails}/{batch_id}"))
        path = spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, spark) -> DataFrame:
        return spark.read.parquet(self.rows).drop("batch")


