"""Category indexes: fit by frequency, look up, export and import."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fit_category_index(df: DataFrame, column: str) -> DataFrame:
    """Index of each category by descending frequency, ties alphabetic.

    The window runs over the aggregated categories, not over the rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), column))
    return counts.select(F.col(column).alias("value"), "count", (rank - 1).cast("double").alias("index"))


def index_frame(spark: SparkSession, labels: list[str]) -> DataFrame:
    """Lookup frame of a declared label list."""
    return spark.createDataFrame([(v, float(i)) for i, v in enumerate(labels)], "value string, index double")


def apply_category_index(df: DataFrame, column: str, index: DataFrame, name: str | None = None) -> DataFrame:
    """Add the index of ``column``; unknown and missing values get the map size.

    A declared map is a small local relation, which Spark broadcasts by its known size; a
    fitted one of unusual size is joined by shuffle instead.
    """
    name = name or f"{column}_index"
    size = index.agg(F.count(F.lit(1)).cast("double").alias("__size"))
    sized = index.select(F.col("value").alias(column), F.col("index").alias("__idx"))
    unknown = size.first()["__size"]
    return (df.join(sized, column, "left")
            .withColumn(name, F.coalesce("__idx", F.lit(unknown))).drop("__idx"))


def category_map(index: DataFrame) -> dict[str, float]:
    """Index as a plain mapping; meant for fitted maps, which hold one row per category."""
    return {r["value"]: r["index"] for r in index.orderBy("index").collect()}


def save_category_map(index: DataFrame, path: str) -> None:
    """One JSON row per category."""
    index.select("value", "index").coalesce(1).write.mode("overwrite").json(path)


def load_category_map(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved map, or a single JSON object ``{"value": index, ...}``."""
    text = spark.read.text(path, wholetext=True)
    as_map = F.from_json("value", "map<string,double>")
    as_row = F.from_json("value", "value string, index double")
    rows = spark.read.text(path).select(as_row.alias("r")).where("r.value is not null and r.index is not null")
    if rows.isEmpty():
        return text.select(F.explode(as_map).alias("value", "index"))
    return rows.select("r.*")


def category_json(labels: list[str]) -> str:
    return json.dumps({v: float(i) for i, v in enumerate(labels)}, indent=4)
