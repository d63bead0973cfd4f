"""Two-sensor merge: match, enrich, count, project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.enrich import csv_line, same_endpoint
from flowloom.operators.history import HISTORY_BLOCK, connection_counters
from flowloom.operators.matching import CARRIED, match_sensors, pass_through
from flowloom.operators.scan import BLOCK_WIDTH, SEQUENCE_WIDTH, dense_sequence
from flowloom.schemas import MERGED_FIELDS, SCORING_FIELDS
from flowloom.session import cut_lineage, stored


def fixed_layout(df: DataFrame, cols: list[str], extra: list[str] | None = None) -> DataFrame:
    """Ordered projection; names the input lacks come out null."""
    present = set(df.columns)
    return df.select(*(extra or []), *[
        F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in cols])


def merged_sequence(flows: DataFrame, merges: DataFrame, same_second: bool = True,
                    block: int = HISTORY_BLOCK, width: int = SEQUENCE_WIDTH, keep=cut_lineage) -> DataFrame:
    """Narrow merged rows with their dense position ``n`` and the seven counters."""
    # narrow; numbering reads it for the block counts and for the rows
    rows = keep(merges.unionByName(pass_through(flows)))
    return connection_counters(dense_sequence(rows, "merge_seq", "n", width), "n", same_second, block=block)


def attach_measurements(flows: DataFrame, rows: DataFrame) -> DataFrame:
    """Bring the flow measurements back by ``a_seq``: the only shuffle of wide rows."""
    wide = flows.drop(*CARRIED, "service").withColumnRenamed("seq", "a_seq")
    known = set(rows.columns) - {"a_seq"}
    wide = wide.select(*[c for c in wide.columns if c not in known])
    return rows.join(wide, "a_seq").withColumn("is_sm_ips_ports", same_endpoint())


def merge_flows(flows: DataFrame, logs: DataFrame, mode: str = "set", same_second: bool = True,
                width: int = BLOCK_WIDTH, block: int = HISTORY_BLOCK,
                sequence_width: int = SEQUENCE_WIDTH) -> DataFrame:
    """Merged flows, 44 fields behind ``merge_seq``.

    ``mode='set'`` folds each http record once; ``mode='replay'`` follows the live loop
    record by record, where http records also stay available to later flows and early ftp
    records wait for a flow.
    """
    if mode == "set":
        merges = match_sensors(flows, logs, width).merges
    elif mode == "replay":
        from flowloom.operators.replay import replay_merges
        merges = replay_merges(flows, logs, width)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # forests draw rows of the set form by their place, so it keeps its partitions
    rows = merged_sequence(flows, merges, same_second, block, sequence_width, stored if mode == "replay" else cut_lineage)
    return fixed_layout(attach_measurements(flows, rows), MERGED_FIELDS, ["merge_seq"])


def scoring_lines(merged: DataFrame) -> DataFrame:
    """41-position scoring line per merged flow."""
    keep = ["merge_seq"] if "merge_seq" in merged.columns else []
    return merged.select(*keep, csv_line(SCORING_FIELDS, merged.columns).alias("line"))
