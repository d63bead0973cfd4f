"""Sinks of streams: one folder per sink, run and micro-batch, so that a repeated batch replaces what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.plans.merge import fixed_layout, scoring_lines
from flowloom.schemas import MERGED_FIELDS
from flowloom.sources.sinks import alert_lines
from flowloom.streaming.history import HistoryBatches
from flowloom.streaming.match import unpack

LOST_LOG_FIELDS = ["z_seq", "kind", "key", "service", "trans_depth", "response_body_len", "is_ftp_login"]
# Rows of a compressed file.
FILE_ROWS = 1_000_000


class RunFolders:
    """Where the rows of a run go: ``<path>/<sink>/run=<run>/batch=<number>``.

    ``run`` names a run and stays the same through its restarts, as its checkpoint does. Texts are written in ``codec``.
    """

    codec = "none"

    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def at(self, sink: str, number: int) -> str:
        return f"{self.path}/{sink}/run={self.run}/batch={number}"

    def json(self, rows: DataFrame, sink: str, number: int) -> None:
        self._texts(rows).option("ignoreNullFields", False).json(self.at(sink, number))

    def text(self, lines: DataFrame, sink: str, number: int) -> None:
        self._texts(lines).text(self.at(sink, number))

    def _texts(self, rows: DataFrame):
        writer = rows.write.mode("overwrite").option("compression", self.codec)
        # a compressed file is read by one task
        return writer if self.codec == "none" else writer.option("maxRecordsPerFile", FILE_ROWS)

    def staged(self, batch: DataFrame, number: int) -> DataFrame:
        """The batch, written once: several sinks read it, and a stateful plan must not run for each of them."""
        batch.write.mode("overwrite").parquet(self.at("staged", number))
        return batch.sparkSession.read.schema(batch.schema).parquet(self.at("staged", number))

    def unstage(self, batch: DataFrame, number: int) -> None:
        path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(self.at("staged", number))
        path.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class RawSink(RunFolders):
    """Rows of one sensor as they came, nulls included, in ``raw/<sensor>``, as compressed JSON."""

    codec = "gzip"

    def __init__(self, path: str, run: str, sensor: str):
        super().__init__(path, run)
        self.sensor = sensor

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.json(batch, f"raw/{self.sensor}", number)


class MergeSinks(RunFolders):
    """Routes the rows of ``stream_merge``: merged flows, scoring lines, and what found no partner.

    ``merged`` holds JSON of ``merge_seq`` and the 44 fields, counters continued from batch to batch, ``scoring`` the
    scoring lines of the same rows, ``unmatched/flows`` the lost flows as they came and ``unmatched/logs`` the lost log
    records. Rows are lost only where the merge has a time to live. All texts are compressed: a merged flow is held
    in ``merged`` and ``scoring`` beside its raw rows, names of all fields with each.
    """

    codec = "gzip"

    def __init__(self, path: str, run: str, flow_schema, same_second: bool = True):
        super().__init__(path, run)
        self.flow_schema = flow_schema
        self.history = HistoryBatches(f"{path}/history/run={run}", same_second)

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = self.staged(batch, number)
        self.text(rows.where("status = 'lost_flow'").select("payload"), "unmatched/flows", number)
        self.json(rows.where("status = 'lost_log'").select(*LOST_LOG_FIELDS), "unmatched/logs", number)
        self.history(unpack(rows.where("status = 'merged'").drop("status"), self.flow_schema), number)
        # the sinks below read the history; the payloads need not stay beside what they write
        self.unstage(batch, number)
        counted = rows.sparkSession.read.parquet(f"{self.history.rows}/batch={number}")
        self.json(fixed_layout(counted, MERGED_FIELDS, ["merge_seq"]), "merged", number)
        self.text(scoring_lines(counted).select("line"), "scoring", number)


class ScoreSinks(RunFolders):
    """Routes scored lines: verdicts, alert lines, and malformed lines as they came with their number."""

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = self.staged(batch, number)
        self.json(rows.where("malformed").select("seq", "line"), "malformed", number)
        good = rows.where("not malformed")
        good.drop("line", "malformed").write.mode("overwrite").parquet(self.at("verdicts", number))
        self.text(alert_lines(good), "alerts", number)
        self.unstage(batch, number)
