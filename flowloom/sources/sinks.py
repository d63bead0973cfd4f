"""Batch sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import enrich
from flowloom.schemas import CLASS_LABELS


def alert_lines(scored: DataFrame, probability: str = "probability", reason: str = "reason") -> DataFrame:
    """One text line per attack that no allow-list entry exempts."""
    hit = enrich.is_attack(F.col(probability)) & F.col(reason).isNull()
    return scored.where(hit).select(enrich.flow_text().alias("line"))


def append_alerts(scored: DataFrame, path: str) -> None:
    alert_lines(scored).write.mode("append").text(path)


def write_run_jsonl(df: DataFrame, path: str, run: str) -> None:
    """JSON lines of one run; a repeated run replaces its own folder only."""
    (df.withColumn("run", F.lit(run)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False)
     .partitionBy("run").json(path))


def write_unmatched(flows: DataFrame, logs: DataFrame, path: str, run: str) -> None:
    """Rows of either sensor that found no partner, once per run."""
    write_run_jsonl(flows, f"{path}/flows", run)
    write_run_jsonl(logs, f"{path}/logs", run)


def write_csv(df: DataFrame, path: str, renames: dict[str, str] | None = None) -> None:
    """CSV with a header, optionally under report column names."""
    df.withColumnsRenamed(renames or {}).write.mode("overwrite").option("header", True).csv(path)


def write_scoring_csv(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)


def report_text(report: DataFrame, accuracy: DataFrame, title: str, names: list[str] | None = None) -> DataFrame:
    """Classification report as text lines: title, accuracies, one line per class and average.

    Classes come in the order of ``names``, their class indexes.
    """
    def number(c):
        return F.lpad(F.coalesce(F.format_string("%.2f", F.col(c)), F.lit("")), 10, " ")
    head = accuracy.select(F.posexplode(F.array(
        F.lit(title), F.format_string("test accuracy: %.2f%%", F.col("accuracy") * 100),
        F.format_string("accuracy on attack rows: %.2f%%", F.col("attack_accuracy") * 100),
        F.concat(F.lpad(F.lit(""), 12, " "), *[F.lpad(F.lit(h), 10, " ") for h in
                                               ("precision", "recall", "f1-score", "support")]))).alias("pos", "line"))
    order = {name: 50 + i for i, name in enumerate(names or CLASS_LABELS)}
    last = 50 + len(order)
    place = {**order, "accuracy": last + 1, "macro avg": last + 2, "weighted avg": last + 3}
    rank = F
    for name, at in place.items():
        rank = rank.when(F.col("class") == name, F.lit(at))
    body = report.select(
        rank.otherwise(F.lit(last)).alias("pos"),
        F.concat(F.lpad("class", 12, " "), number("precision"), number("recall"), number("f1"),
                 F.lpad(F.col("support").cast("string"), 10, " ")).alias("line"))
    return head.unionByName(body).orderBy("pos", "line").select("line")


def write_report(report: DataFrame, accuracy: DataFrame, title: str, path: str) -> None:
    # a handful of lines
    report_text(report, accuracy, title).coalesce(1).write.mode("overwrite").text(path)
