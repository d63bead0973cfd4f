"""Shape of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from flowloom.catalog import fixtures
from flowloom.operators import dataset, history, matching, netranges, profile, scan, timematch
from flowloom.schemas import NUMERIC_FIELDS

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def flows(spark):
    return fixtures.flows(spark, SF)


def test_counters_need_one_exchange_and_no_single_task(spark):
    df = spark.range(1000).select(
        (F.col("id") + 1).alias("n"), F.lit("-").alias("service"), F.lit("a").alias("saddr"), F.lit("b").alias("daddr"),
        F.lit(1).alias("sport"), F.lit(2).alias("dport"), F.lit(3).alias("ltime"))
    plan = _plan(history.connection_counters(df, "n"))
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "SinglePartition" not in plan


def test_numbering_never_moves_rows_to_one_task(flows):
    plan = _plan(scan.dense_sequence(flows.select("seq"), "seq"))
    # only sums per superblock meet in one place
    for line in plan.splitlines():
        if "SinglePartition" in line or "hashpartitioning(0" in line:
            assert "seq" not in line
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("build", [
    lambda a, z: matching.fifo_match(a.select(F.col("proto").alias("key"), F.col("seq").alias("a_seq")),
                                     z.select(F.col("proto").alias("key"), F.col("seq").alias("z_seq"))),
    lambda a, z: matching.match_sensors(a, z).merges,
    lambda a, z: timematch.band_semi(a.select(F.col("stime_us").alias("a_us")), z.select(F.col("ts_us").alias("z_us")), 500),
    lambda a, z: timematch.nearest_time_match(a.select(F.col("seq").alias("a_seq"), F.col("stime_us").alias("a_us")),
                                              z.select(F.col("seq").alias("z_seq"), F.col("ts_us").alias("z_us")), 500),
    lambda a, z: netranges.allow_reason(a, netranges.static_ranges(a.sparkSession), broadcast_limit=0),
], ids=["fifo", "merge", "band", "nearest", "ranges"])
def test_joins_are_equi_joins(spark, flows, build):
    plan = _plan(build(flows, fixtures.logs(spark, SF)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_profile_reads_the_table_once_and_only_its_columns(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = _plan(profile.sentinel_profile(lines, ["l_quantity", "l_tax"]))
    assert len(re.findall(r"FileScan", plan)) == 1
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_tax:double>", plan)


def test_labels_filter_reaches_the_scan(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    plan = _plan(profile.value_counts(events.where("event_type = 'error'"), ["user_id"]))
    assert "EqualTo(event_type,error)" in plan


def test_sample_has_no_global_limit(flows):
    plan = _plan(dataset.exact_sample(flows, {0: 100, 1: 50}, "label", "seq"))
    assert "GlobalLimit" not in plan and "TakeOrdered" not in plan


def test_describe_stays_in_the_jvm(flows):
    assert "Python" not in _plan(profile.describe(flows, NUMERIC_FIELDS, approx=True))
