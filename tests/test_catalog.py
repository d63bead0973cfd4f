"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from flowloom.catalog.oracle import SQL
from flowloom.catalog.queries import QUERIES
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
# covered by the other tests or by the merge itself; the check tool runs them all
SLOW = {"scoring_csv", "counters_any_second", "http_profile", "replay_flows", "stream_counters", "stream_merge", "rf_scores",
        "rf_report", "rf_verdicts", "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm",
        "ct_dst_sport_ltm", "protocol_routes", "merge_sequence", "stream_alerts"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())
    assert set(QUERIES) - set(SQL) == {"describe_approximate", "rf_scores", "rf_report", "rf_verdicts"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_sql(spark, con, name):
    got = compare(spark, con, name, entry_point.queries()[name], entry_point.oracle_sql()[name], SF)
    assert got.startswith("ok"), got


def test_entry(spark):
    assert entry_point.entry(spark).limit(1).count() == 1
