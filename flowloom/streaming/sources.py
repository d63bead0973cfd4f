"""Streaming sources of both sensors and of scoring lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.schemas import LOG_KINDS, LOG_SCHEMA, SCORING_FIELDS, SCORING_SCHEMA  # noqa: F401
from flowloom.sources.arrival import line_session, placed_lines, placed_records, queue_rows
from flowloom.sources.flows import normalize_logs, parse_flow_lines, parse_log_lines, union_logs


def _limits(reader, max_files: int | None):
    reader = reader.option("latestFirst", False)
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def flow_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Sensor-A CSV files as they land, each flow with the place of its line in ``seq``; headers and management rows go."""
    return parse_flow_lines(placed_lines(_limits(line_session(spark).readStream, max_files).text(path)))


def log_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Sensor-B JSON logs from one folder per kind, each record with the place of its line in ``seq``."""
    reading = line_session(spark)
    return normalize_logs(union_logs({
        kind: parse_log_lines(placed_lines(_limits(reading.readStream, max_files).text(f"{root}/{kind}"))) for kind in LOG_KINDS}))


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None,
                 starting: str = "earliest") -> DataFrame:
    """Text records of Kafka topics with their place in ``seq`` (needs the connector jar)."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return placed_records(reader.load())


def queued_flows(records: DataFrame) -> DataFrame:
    """Typed flows of placed queue records that hold CSV lines."""
    return parse_flow_lines(records)


def queued_logs(by_kind: dict[str, DataFrame]) -> DataFrame:
    """Log records of placed queue records that hold JSON lines, by the kind of their topic."""
    return normalize_logs(union_logs({kind: parse_log_lines(records) for kind, records in by_kind.items()}))


def kafka_sink(rows: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "key", trigger: dict | None = None):
    """Start a query that appends ``rows`` to a Kafka topic as JSON under their ``key`` (needs the connector jar)."""
    return (queue_rows(rows, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def scoring_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Scoring lines as typed rows with the place of their line in ``seq``; values that are no number come out null."""
    return parse_scoring(placed_lines(_limits(line_session(spark).readStream, max_files).text(path)).withColumnRenamed("value", "line"))


def parse_scoring(lines: DataFrame) -> DataFrame:
    """Typed scoring rows; ``malformed`` marks lines of another width, whose missing fields are null.

    The line itself and whatever numbers it (``seq``, ``merge_seq``) stay beside the fields.
    """
    parts = F.split("line", ",", -1)
    kinds = {f.name: f.dataType for f in SCORING_SCHEMA}
    kept = [c for c in ("seq", "merge_seq", "line") if c in lines.columns]
    return lines.select(*kept, *[F.get(parts, F.lit(i)).try_cast(kinds[c]).alias(c) for i, c in enumerate(SCORING_FIELDS)],
                        (F.size(parts) != len(SCORING_FIELDS)).alias("malformed"))
