"""Classifier evaluation as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.schemas import CLASS_LABELS


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes: int = len(CLASS_LABELS)) -> DataFrame:
    """Count per (label, prediction); absent combinations are listed with 0."""
    grid = (df.sparkSession.range(classes * classes)
            .select(F.floor(F.col("id") / classes).cast("int").alias("label"),
                    F.pmod("id", F.lit(classes)).cast("int").alias("prediction")))
    counted = (df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))
               .agg(F.count(F.lit(1)).alias("n")))
    return grid.join(counted, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(matrix: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    Works on the confusion counts (classes squared rows); a zero division counts as 0.
    """
    names = names or CLASS_LABELS
    # each cell is seen once from its label and once from its prediction
    sides = matrix.select("label", "prediction", "n", F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.lit("actual").alias("side")),
        F.struct(F.col("prediction").alias("class"), F.lit("predicted").alias("side")))).alias("s"))
    hit = F.col("label") == F.col("prediction")
    counts = sides.groupBy(F.col("s.class").alias("class")).agg(
        F.sum(F.when(F.col("s.side") == "actual", F.col("n"))).alias("support"),
        F.sum(F.when(F.col("s.side") == "predicted", F.col("n"))).alias("predicted"),
        F.sum(F.when((F.col("s.side") == "actual") & hit, F.col("n"))).alias("hits"))

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    hits = F.coalesce("hits", F.lit(0))
    rates = counts.select("class", "support", hits.alias("hits"),
                          ratio(hits, F.col("predicted")).alias("precision"),
                          ratio(hits, F.col("support")).alias("recall"))
    per_class = rates.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"),
                                             F.col("precision") + F.col("recall")))
    measures = ["precision", "recall", "f1"]
    total = F.sum("support")
    summary = per_class.agg(
        total.alias("support"), ratio(F.sum("hits"), total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in measures])
    nothing = F.lit(None).cast("double")
    rows = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), nothing.alias("precision"), nothing.alias("recall"),
                 F.col("accuracy").alias("f1"), F.col("support")),
        *[F.struct(F.lit(f"{k} avg").alias("class"), *[F.col(f"{k}_{m}").alias(m) for m in measures],
                   F.col("support")) for k in ("macro", "weighted")])).alias("r")).select("r.*")
    title = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("class") + 1)
    return per_class.select(title.alias("class"), *measures, "support").unionByName(rows)


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction", normal: int = 0) -> DataFrame:
    """Share of right predictions overall and among the rows that are not normal.

    The second is 0 where there is no such row.
    """
    right = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(right).alias("accuracy"),
                  F.coalesce(F.avg(F.when(F.col(label) != normal, right)), F.lit(0.0)).alias("attack_accuracy"))


def mean_accuracy(results: DataFrame, params: list[str], score: str = "accuracy") -> DataFrame:
    """Mean score over folds for every parameter set."""
    return results.groupBy(*params).agg(F.avg(score).alias("mean_accuracy"), F.count(F.lit(1)).alias("folds"))


def best_params(means: DataFrame, params: list[str]) -> DataFrame:
    """Parameter set with the highest mean accuracy."""
    return means.agg(F.max_by(F.struct(*params), "mean_accuracy").alias("best"),
                     F.max("mean_accuracy").alias("mean_accuracy")).select("best.*", "mean_accuracy")
