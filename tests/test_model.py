import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowloom.operators import evaluation
from flowloom.plans import scoring, training
from flowloom.schemas import CLASS_LABELS

SMALL = {"numTrees": 5, "maxDepth": 4, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 2}


@pytest.fixture(scope="module")
def labelled(spark):
    """The label follows dur; fifty protocols exceed the default number of bins."""
    return spark.range(400).select(
        F.col("id").alias("seq"), F.concat(F.lit("p"), F.col("id") % 50).alias("proto"), F.lit("FIN").alias("state"),
        F.col("id").cast("string").alias("dur"), F.lit(None).cast("string").alias("sjit"),
        F.lit("10.0.0.1").alias("saddr"), F.lit("8.8.8.8").alias("daddr"), F.lit(1).alias("sport"), F.lit(2).alias("dport"),
        F.lit("5").alias("stime"), (F.col("id") >= 200).cast("int").alias("label"))


@pytest.fixture(scope="module")
def fitted(labelled):
    rows = training.with_target(training.feature_columns(labelled))
    train, test = training.split(rows, "seq")
    return training.pipeline(training.forest(SMALL)).fit(train), train, test


def test_feature_order():
    assert len(training.feature_order()) == 41 and len(training.feature_order(False)) == 28
    assert training.feature_order()[-2:] == ["proto_index", "state_index"]


def test_missing_values_are_minus_one(labelled):
    r = training.feature_columns(labelled).first()
    assert (r.sjit, r.ct_srv_src, r.sport) == (-1.0, -1.0, 1.0)


def test_target_order_is_pinned(spark, rows):
    df = spark.createDataFrame([(1,), (1,), (0,), (None,)], "label int")
    assert rows(training.with_target(df), "label", "target") == [(0, 0.0), (1, 1.0), (1, 1.0), (None, 0.0)]


def test_fit_and_report(fitted):
    model, _, test = fitted
    found = training.evaluate(model, test)
    assert found["accuracy"].first().accuracy > 0.9
    assert [r["class"] for r in found["report"].collect()][:2] != [] and found["matrix"].count() == 4


def test_bundle_round_trip(spark, fitted, tmp_path):
    model, _, test = fitted
    training.save_bundle(model, str(tmp_path))
    loaded, order = training.load_bundle(spark, str(tmp_path))
    assert order == training.feature_order()
    probe = test.limit(20)
    a = [r.probability for r in training.attack_probability(model.transform(probe)).orderBy("seq").collect()]
    b = [r.probability for r in training.attack_probability(loaded.transform(probe)).orderBy("seq").collect()]
    assert a == b
    assert len(training.category_labels(loaded)["proto"]) > 40


def test_unseen_category_gets_the_map_size(fitted):
    model, train, test = fitted
    probe = test.withColumn("state", F.lit("NEW"))
    assert {r.state_index for r in model.transform(probe).collect()} == {1.0}
    dense = training.dense_features(model.transform(probe)).first().features
    assert len(dense) == 41


def test_scoring_reports_the_row_as_it_came(spark, fitted, labelled):
    model, _, _ = fitted
    ranges = spark.createDataFrame([("aws", "10.0.0.0/8")], "provider string, cidr string")
    got = {r.seq: r for r in scoring.score(labelled, model, ranges, now=F.lit(9.0)).collect()}
    assert len(got) == 400
    assert got[399].verdict == "ignored(AWS)" and got[0].verdict == "normal"
    assert got[0].flow == "10.0.0.1:1 -> 8.8.8.8:2" and got[0].latency == 4.0
    free = scoring.score(labelled, model, ranges.where("false"), now=F.lit(9.0)).where("seq = 399").first()
    assert free.verdict == "attack" and free.severity in ("high", "low")


def test_search_uses_stratified_folds(fitted):
    _, train, _ = fitted
    grid = [{**SMALL, "maxDepth": 1, "numTrees": 2}, SMALL]
    found = training.search(train, grid, "seq", folds=2, parallelism=2)
    assert len(found.avgMetrics) == 2 and max(found.avgMetrics) > 0.9
    assert found.bestModel.stages[-1].getNumTrees in (2, 5)


def test_search_computes_its_folds_once(spark, fitted):
    _, train, _ = fitted
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    found = training.search(train.mapInArrow(count, train.schema), [{**SMALL, "numTrees": 2}], "seq", folds=2, parallelism=1)
    assert len(found.avgMetrics) == 1
    # a scan over blocks reads its rows once for the totals and once for the rows
    assert seen.value <= 2 * train.count()


def test_best_parameters(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, 0.9), (2, 0.1)], "depth int, accuracy double")
    best = evaluation.best_params(evaluation.mean_accuracy(df, ["depth"]), ["depth"]).first()
    assert best.depth == 1 and best.mean_accuracy == pytest.approx(0.6)


def test_class_names():
    assert CLASS_LABELS[training.ATTACK] == "Attack" and vector_to_array is not None
