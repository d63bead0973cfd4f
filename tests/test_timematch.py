import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import enrichment, timematch
from tests import models

A, Z = "a_seq bigint, a_us bigint", "z_seq bigint, z_us bigint"


def _frames(spark, a, z):
    return spark.createDataFrame(a, A), spark.createDataFrame(z, Z)


def test_tolerance_takes_the_smallest_time(spark, rows):
    a, z = _frames(spark, [(1, 10_000), (2, 12_000)], [(1, 11_000), (2, 11_500)])
    pairs = timematch.nearest_time_match(a, z, 1000)
    assert rows(pairs) == [(1, 10_000, 1, 11_000), (2, 12_000, 2, 11_500)]
    assert timematch.inexact_matches(pairs).count() == 2


def test_record_order_decides(spark, rows):
    a, z = _frames(spark, [(1, 10_000)], [(1, 10_500), (2, 10_000)])
    pairs = timematch.nearest_time_match(a, z, 1000)
    assert rows(pairs) == [(1, 10_000, 1, 10_500)]
    assert rows(timematch.unmatched(z, pairs, "z_seq")) == [(2, 10_000)]


@pytest.mark.parametrize("delta", [0, 7, 40])
@pytest.mark.parametrize("order", ["shuffled", "sorted"])
def test_nearest_equals_the_global_greedy(spark, rows, delta, order):
    r = random.Random(delta)
    # a third of the rows share one dense second
    def times(n):
        return [r.randrange(300) if r.random() < 0.35 else r.randrange(30_000) for _ in range(n)]
    a = [(i, t) for i, t in enumerate(times(500))]
    zt = times(500)
    z = [(i, t) for i, t in enumerate(sorted(zt) if order == "sorted" else zt)]
    fa, fz = _frames(spark, a, z)
    assert sorted(rows(timematch.nearest_time_match(fa, fz, delta))) == models.nearest(a, z, delta)


@pytest.mark.parametrize("order", ["shuffled", "sorted", "late"])
def test_blocks_hand_refused_rows_on(spark, rows, order):
    r = random.Random(21)
    # one dense stretch in which nearly every row depends on the one before
    a = [(i, r.randrange(2500)) for i in range(700)]
    zt = sorted(r.randrange(2500) for _ in range(800))
    if order == "shuffled":
        r.shuffle(zt)
    if order == "late":
        zt.append(zt.pop(100))
    z = list(enumerate(zt))
    fa, fz = _frames(spark, a, z)
    assert sorted(rows(timematch.nearest_time_match(fa, fz, 15, block=32))) == models.nearest(a, z, 15)


def test_dense_island_spreads_over_tasks(spark, rows, monkeypatch):
    """No pause anywhere and one late record: the rows of the island are answered in blocks of the same size."""
    asked = []
    settle = timematch.settle

    def watched(first, answer, onward, block, row):
        asked.append([r["n"] for r in first.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).collect()])
        return settle(first, answer, onward, block, row)
    monkeypatch.setattr(timematch, "settle", watched)
    a = [(i, i) for i in range(2000)]
    z = [(i, i + 1) for i in range(1, 2000)] + [(2000, 1)]
    assert sorted(rows(timematch.nearest_time_match(*_frames(spark, a, z), 5, block=100))) == models.nearest(a, z, 5)
    assert len(asked[0]) == 20 and max(asked[0]) <= 110
    ka, kz = [("k", 2 * i, t) for i, t in a], [("k", 2 * i + 1, t) for i, t in z]
    pairs = timematch.interval_match(spark.createDataFrame(ka, "key string, " + A), spark.createDataFrame(kz, "key string, " + Z), 5, block=100)
    assert sorted(rows(pairs)) == models.interval(ka, kz, 5)
    assert len(asked[1]) == 20 and max(asked[1]) <= 120


def test_refusals_along_the_whole_table_take_few_rounds(spark, rows, monkeypatch):
    """Every block refuses rows to the next one: blocks grow with the table, so that there are 20 at most."""
    rounds = []
    settle = timematch.settle

    def watched(first, answer, onward, block, row):
        def counted(asked):
            rounds.append(None)
            return answer(asked)
        return settle(first, counted, onward, block, row)
    monkeypatch.setattr(timematch, "settle", watched)
    a, z = [(i, 10 * i) for i in range(400)], [(i, 10 * i + 1) for i in range(400)]
    assert sorted(rows(timematch.nearest_time_match(*_frames(spark, a, z), 35, block=4))) == models.nearest(a, z, 35)
    assert 2 < len(rounds) <= 21


@pytest.mark.parametrize("delta", [0, 5, 30])
def test_band_predicates(spark, rows, delta):
    r = random.Random(delta)
    a = [(i, r.choice([50, r.randrange(3000)])) for i in range(150)]
    z = [(i, r.randrange(3000)) for i in range(300)]
    fa, fz = _frames(spark, a, z)
    near = sorted(((s, t) for s, t in z if any(abs(t - x) <= delta for _, x in a)), key=repr)
    assert rows(timematch.band_semi(fa, fz, delta)) == near
    assert rows(timematch.band_anti(fa, fz, delta)) == sorted(set(z) - set(near), key=repr)


@pytest.mark.parametrize("tolerance,span,block", [(6, 4000, 1 << 16), (6, 4000, 16), (40, 1000, 16), (0, 60, 8), (300, 900, 50)])
@pytest.mark.parametrize("late", [True, False])
def test_interval_match_equals_the_cache_loop(spark, rows, tolerance, span, block, late):
    r = random.Random(tolerance + span)
    times = [r.randrange(span) for _ in range(800)]
    if not late:
        times.sort()
    names = ["hot" if r.random() < 0.4 else r.choice("pq") for _ in times]
    a = [(k, i, t) for i, (k, t) in enumerate(zip(names, times)) if i % 2 == 0]
    z = [(k, i, t) for i, (k, t) in enumerate(zip(names[::-1], times)) if i % 2]
    fa = spark.createDataFrame(a, "key string, " + A)
    fz = spark.createDataFrame(z, "key string, " + Z)
    assert sorted(rows(timematch.interval_match(fa, fz, tolerance, block=block))) == models.interval(a, z, tolerance)


def test_summary_counts_unreadable_records(spark):
    a, z = _frames(spark, [(1, 10), (2, 20)], [(1, 10), (2, None), (3, 99)])
    pairs = timematch.nearest_time_match(a, z.where("z_us is not null"), 0)
    got = timematch.match_summary(a, z, pairs).first().asDict()
    assert got == {"total_b": 3, "total_a": 2, "matched": 1, "inexact": 0, "unmatched_b": 2, "unmatched_a": 1,
                   "invalid_b": 1}


LOG = ("seq bigint, zeek_log string, orig_h string, orig_p bigint, resp_h string, resp_p bigint, ts_us bigint, "
       "service string, trans_depth bigint, response_body_len bigint, method string, user_name string, "
       "password string, command string")


def _log(seq, kind, us, method=None, port=1, depth=None):
    return (seq, kind, "s", port, "d", 2, us, None, depth, None, method, None, None, None)


def test_conn_takes_the_latest_http_once(spark, rows):
    z = spark.createDataFrame([_log(1, "http", 1, "A"), _log(2, "http", 2, "B"), _log(3, "conn", 3), _log(4, "conn", 4)], LOG)
    got = enrichment.conn_enrich(z, ttl=100)
    assert rows(got, "seq", "method", "response_body_len") == [(3, "B", 0), (4, None, None)]


def test_stale_and_incomplete_records(spark, rows):
    z = spark.createDataFrame([_log(1, "http", 1, "A"), _log(2, "conn", 200), _log(3, "conn", 300, port=0)], LOG)
    assert rows(enrichment.conn_enrich(z, ttl=100), "seq", "method") == [(2, None)]


def test_enrichment_across_blocks(spark, rows):
    z = spark.createDataFrame([_log(1, "http", 1, "A"), _log(500, "conn", 2), _log(900, "conn", 3)], LOG)
    assert rows(enrichment.conn_enrich(z, ttl=100, width=10), "seq", "method") == [(500, "A"), (900, None)]
