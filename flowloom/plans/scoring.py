"""Merged rows to verdicts and alerts; the same plan serves batch and stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.functions import enrich
from flowloom.operators.netranges import allow_reason
from flowloom.plans.training import attack_probability, feature_columns
from flowloom.sources.sinks import alert_lines
from flowloom.streaming.sources import parse_scoring

TRIGGER = "1 second"


def score(flows: DataFrame, model: PipelineModel, ranges: DataFrame, with_protocol_features: bool = True,
          now=None) -> DataFrame:
    """Probability of attack, allow-list reason, verdict, severity and latency per flow."""
    shown = ["saddr", "sport", "daddr", "dport"]
    # the features overwrite missing values with -1, the report shows the row as it came
    kept = flows.select("*", *[F.col(c).alias(f"__{c}") for c in shown], F.col("stime").alias("__stime"))
    scored = attack_probability(model.transform(feature_columns(kept, with_protocol_features)))
    rows = scored.select("probability", *[F.col(f"__{c}").alias(c) for c in shown], F.col("__stime").alias("stime"),
                         *[c for c in ("seq", "merge_seq", "line", "malformed") if c in flows.columns])
    reasoned = allow_reason(rows, ranges)
    p, r = F.col("probability"), F.col("reason")
    return reasoned.select(*rows.columns, "reason", enrich.verdict(p, r).alias("verdict"),
                           enrich.severity(p, r).alias("severity"), enrich.flow_text().alias("flow"),
                           enrich.latency_seconds(F.col("stime"), now).alias("latency"))


def score_lines(lines: DataFrame, model: PipelineModel, ranges: DataFrame, now=None) -> DataFrame:
    """Verdicts of scoring lines (``line`` and a number beside it), batch or stream.

    Lines of another width stay in the result, flagged ``malformed`` and without probability, verdict or severity:
    what their fields mean is not known.
    """
    scored = score(parse_scoring(lines), model, ranges, now=now)
    judged = ("probability", "reason", "verdict", "severity", "flow", "latency")
    return scored.withColumns({c: F.when(~F.col("malformed"), F.col(c)) for c in judged})


def with_latency_metrics(scored: DataFrame, name: str = "latency") -> DataFrame:
    """Observed metrics of the latency column, reported once per batch."""
    return scored.observe(name, F.count(F.lit(1)).alias("rows"), F.avg("latency").alias("mean"),
                          F.max("latency").alias("max"))


def alert_stream(scored: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append alert lines as they are found.

    The trigger and the rate limits of the source stand for batch size and back-pressure.
    """
    return (alert_lines(scored).writeStream.format("text").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"processingTime": TRIGGER})).start())
