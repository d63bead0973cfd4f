"""Labelled flows to an evaluated random-forest model."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.coerce import class_name, double_of
from flowloom.operators import evaluation
from flowloom.operators.dataset import canonical_names, hash_split, stratified_folds
from flowloom.schemas import CATEGORICAL_FIELDS, CLASS_LABELS, NUMERIC_FIELDS, PROTOCOL_FEATURES
from flowloom.session import cut_lineage

ATTACK = CLASS_LABELS.index("Attack")
# The searched parameters. Spark has no minimum split size and stops at depth 30.
DEFAULT_GRID = [{"numTrees": 300, "maxDepth": 20, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 9}]
FOLDS = 15


def feature_order(with_protocol_features: bool = True) -> list[str]:
    """Model feature order: 41 features, or 28 without the second sensor."""
    extra = PROTOCOL_FEATURES if with_protocol_features else []
    return [*NUMERIC_FIELDS, *extra, *[f"{c}_index" for c in CATEGORICAL_FIELDS]]


def feature_columns(df: DataFrame, with_protocol_features: bool = True) -> DataFrame:
    """Numeric features as doubles with -1 for missing values or columns.

    Training and scoring both pass through here, so they see the same values.
    """
    df = canonical_names(df)
    present = dict(df.dtypes)
    numeric = [*NUMERIC_FIELDS, *(PROTOCOL_FEATURES if with_protocol_features else [])]

    def value(c: str) -> Column:
        return F.coalesce(double_of(c, present[c]), F.lit(-1.0)) if c in present else F.lit(-1.0)
    kept = [c for c in df.columns if c not in set(numeric)]
    return df.select(*kept, *[value(c).alias(c) for c in numeric])


def with_target(df: DataFrame, label: str = "label") -> DataFrame:
    """Class name and target; the index order Normal=0, Attack=1 is pinned."""
    named = df.withColumn("attack_type", class_name(F.col(label)))
    index = StringIndexerModel.from_labels(CLASS_LABELS, inputCol="attack_type", outputCol="target")
    return index.transform(named)


def pipeline(classifier: RandomForestClassifier, with_protocol_features: bool = True) -> Pipeline:
    """Category indexers, assembly and forest.

    The indexes enter as plain numbers: as nominal attributes they would exceed the bins.
    """
    raw = [f"{c}_raw" for c in CATEGORICAL_FIELDS]
    indexer = StringIndexer(inputCols=CATEGORICAL_FIELDS, outputCols=raw, handleInvalid="keep")
    plain = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"{c}_raw + 0.0D AS {c}_index" for c in CATEGORICAL_FIELDS) + " FROM __THIS__")
    assembler = VectorAssembler(inputCols=feature_order(with_protocol_features), outputCol="features")
    return Pipeline(stages=[indexer, plain, assembler, classifier])


def forest(params: dict | None = None, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="target", featuresCol="features", seed=seed,
                                  **(params or DEFAULT_GRID[0]))


def split(df: DataFrame, row_id: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """80/20 split; by row hash where an id is given, which no repartitioning changes."""
    if row_id is None:
        train, test = df.randomSplit([0.8, 0.2], seed=seed)
        return train, test
    flagged = hash_split(df, row_id, 0.8, seed)
    return flagged.where("is_train").drop("is_train"), flagged.where("not is_train").drop("is_train")


def search(train: DataFrame, grid: list[dict], row_id: str, folds: int = FOLDS, parallelism: int = 4,
           with_protocol_features: bool = True) -> CrossValidatorModel:
    """Cross-validated search by mean accuracy over stratified folds; refits the best."""
    classifier = forest(grid[0])
    maps = [{classifier.getParam(k): v for k, v in params.items()} for params in grid]
    # every fold and the final fit read it several times
    folded = cut_lineage(stratified_folds(train, "target", row_id, folds))
    validator = CrossValidator(
        estimator=pipeline(classifier, with_protocol_features), estimatorParamMaps=maps,
        evaluator=MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy"),
        numFolds=folds, foldCol="fold", parallelism=parallelism)
    return validator.fit(folded)


def attack_probability(scored: DataFrame, name: str = "probability") -> DataFrame:
    """Probability vector to the probability of attack."""
    return scored.withColumn(name, vector_to_array("probability")[ATTACK])


def dense_features(df: DataFrame, name: str = "features") -> DataFrame:
    """Feature vector as an array of float32, still distributed."""
    return df.withColumn(name, vector_to_array(name, "float32"))


def evaluate(model: PipelineModel, test: DataFrame) -> dict[str, DataFrame]:
    """Confusion matrix, classification report and accuracies on a held-out frame."""
    predicted = model.transform(test).select(F.col("target").cast("int").alias("label"),
                                             F.col("prediction").cast("int").alias("prediction"))
    matrix = evaluation.confusion_matrix(predicted)
    return {"matrix": matrix, "report": evaluation.classification_report(matrix),
            "accuracy": evaluation.accuracy(predicted)}


def save_bundle(model: PipelineModel, path: str, with_protocol_features: bool = True) -> None:
    """Model with its indexers in one pipeline, and the feature order beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    order = json.dumps(feature_order(with_protocol_features))
    spark.createDataFrame([(order,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/feature_order")


def load_bundle(spark, path: str) -> tuple[PipelineModel, list[str]]:
    order = json.loads(spark.read.text(f"{path}/feature_order").first()[0])
    return PipelineModel.load(f"{path}/model"), order


def category_labels(model: PipelineModel) -> dict[str, list[str]]:
    """Labels per categorical column, in index order."""
    return dict(zip(CATEGORICAL_FIELDS, [list(x) for x in model.stages[0].labelsArray]))
