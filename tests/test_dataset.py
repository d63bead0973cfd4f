import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.operators import dataset, evaluation, profile


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(2000).select(F.col("id").alias("seq"), F.when(F.col("id") % 9 == 0, 1).otherwise(0).alias("label"))


def test_balance_is_exact_and_repeatable(labelled):
    sample = dataset.balance(labelled, n_pos=50, ratio=3)
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {1: 50, 0: 150}
    again = dataset.balance(labelled.repartition(7), n_pos=50, ratio=3)
    assert sorted(r.seq for r in sample.collect()) == sorted(r.seq for r in again.collect())
    other = dataset.balance(labelled, n_pos=50, ratio=3, seed=1)
    assert sorted(r.seq for r in sample.collect()) != sorted(r.seq for r in other.collect())


def test_balance_refuses_short_classes(spark):
    df = spark.createDataFrame([(i, 1) for i in range(5)] + [(9, 0)], "seq bigint, label int")
    with pytest.raises(dataset.NotEnoughRows):
        dataset.balance(df, n_pos=6, ratio=0)
    with pytest.raises(ValueError, match="srcip"):
        dataset.balance(df, n_pos=1, columns=["srcip"])


def test_labels_are_coerced(spark, rows):
    df = spark.createDataFrame([("1",), ("0.0",), ("2",), ("x",), (None,)], "label string")
    assert rows(dataset.valid_labels(df)) == [(0,), (1,)]


def test_projection_follows_declared_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "label int, proto int, sport int")
    assert dataset.ordered_projection(df, ["label", "proto", "sport", "dur"]).columns == ["sport", "proto", "label"]


def test_folds_are_even_per_class(labelled):
    folds = dataset.stratified_folds(labelled, "label", "seq", 15).groupBy("label", "fold").count().toPandas()
    for _, part in folds.groupby("label"):
        assert len(part) == 15 and part["count"].max() - part["count"].min() <= 1


def test_split_does_not_depend_on_partitions(labelled):
    a = dataset.hash_split(labelled, "seq").where("is_train")
    b = dataset.hash_split(labelled.repartition(5), "seq").where("is_train")
    assert sorted(r.seq for r in a.collect()) == sorted(r.seq for r in b.collect())
    assert 0.75 < a.count() / 2000 < 0.85


def test_seeded_order_is_a_permutation(labelled):
    order = [r.seq for r in dataset.seeded_order(labelled, "seq").collect()]
    assert sorted(order) == list(range(2000)) and order != sorted(order)


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_across_signs_and_sizes(spark, seed):
    """Negative values, zeros, tiny and huge ones, groups of one and two rows; a null key forms no group."""
    r = np.random.default_rng(seed)
    big = np.concatenate([-np.exp(r.normal(0, 30, 400)), np.zeros(seed * 90), np.exp(r.normal(0, 30, 500)), r.integers(-3, 3, 200)])
    groups = {"big": big, "one": np.array([-7.5]), "two": np.array([1e-300, 1e300]), "ties": np.repeat([1.5, -2.0], [5, 4])}
    pairs = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(pairs, "column string, value double").repartition(4)
    got = {x.column: x for x in profile.exact_quantiles(df, ["column"], profile.PERCENTILES).collect()}
    assert set(got) == set(groups)
    for name, xs in groups.items():
        for p, q in profile.PERCENTILES.items():
            assert got[name][p] == pytest.approx(np.quantile(xs, q), rel=1e-9), (name, p)


def test_bins_rise_with_their_values(spark):
    values = [float("-inf"), -1e308, -3.0, -1.0, -0.999, -5e-324, -0.0, 0.0, 5e-324, 0.5, 1.0, 1.02, 2.0, 1e308, float("inf")]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    bins = [r[0] for r in df.select(profile._bin(F.col("v"))).collect()]
    assert bins == sorted(bins) and bins[6] == bins[7] and len(set(bins)) > 10


def test_quantiles_with_heavy_ties(spark):
    r = np.random.default_rng(0)
    values = np.where(r.random(3000) < 0.4, 7.0, r.normal(size=3000))
    df = spark.createDataFrame(pd.DataFrame({"column": "x", "value": values}))
    got = profile.exact_quantiles(df, ["column"], profile.PERCENTILES).first()
    for name, p in profile.PERCENTILES.items():
        assert got[name] == pytest.approx(np.quantile(values, p))


def test_profile_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, "x"), (None, "-1"), (None, "0")], "a double, b string")
    got = {r["column"]: r for r in profile.full_profile(df, ["a", "b", "absent"]).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["count"], got["a"]["nulls"], got["a"]["p50"]) == (0, 3, None)
    assert (got["b"]["zeros"], got["b"]["minus_ones"], got["b"]["nulls"], got["b"]["p50"]) == (1, 1, 1, -0.5)


def test_short_flows_list_empty_groups(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (9, 1.0)], "spkts int, sjit double")
    got = {r.packets: r for r in profile.short_flow_stats(df).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].flows, got[1]["mean"], got[1].nulls) == (2, 5.0, 1)
    assert (got[2].flows, got[2]["mean"], got[2].zeros) == (0, None, 0)


def test_shares_of_an_empty_table(spark):
    got = profile.label_shares(spark.createDataFrame([], "label int")).first()
    assert (got.total, got.attack_pct, got.normal_pct) == (0, 0.0, 0.0)
    assert profile.has_value(spark.createDataFrame([], "label int"), "label", 1).first()[0] is False


def test_report_on_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    report = {r["class"]: r for r in evaluation.classification_report(evaluation.confusion_matrix(df)).collect()}
    assert (report["Attack"].precision, report["Attack"].recall, report["Attack"].support) == (0.0, 0.0, 0)
    assert report["accuracy"].f1 == 1.0
    assert evaluation.accuracy(df).first().attack_accuracy == 0.0
