import random
from collections import defaultdict

from pyspark.sql import functions as F

from flowloom.operators import scan


def _skewed(n=3000, seed=1):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.4 else f"k{r.randrange(40)}", i, r.choice([None, 1, 5, 9])) for i in range(n)]


def test_keyed_scan_splits_a_hot_key(spark, rows):
    data = _skewed()
    df = spark.createDataFrame(data, "key string, seq bigint, v bigint")
    got = scan.keyed_scan(df, ["key"], "seq", [
        scan.Running("total", F.col("v")), scan.Running("before", F.col("v"), "sum", inclusive=False),
        scan.Running("seen", F.col("v"), "last", inclusive=False), scan.Running("top", F.col("v"), "max"),
        scan.Running("low", F.col("v"), "min")], width=64)
    state, want = defaultdict(list), []
    for k, s, v in data:
        past = [x for x in state[k] if x is not None]
        state[k].append(v)
        upto = past + ([v] if v is not None else [])
        want.append((k, s, v, sum(upto), sum(past), past[-1] if past else None,
                     max(upto) if upto else None, min(upto) if upto else None))
    assert rows(got) == sorted(want, key=repr)


def test_dense_sequence_equals_row_number(spark, rows):
    values = random.Random(2).sample(range(1_000_000), 3000)
    df = spark.createDataFrame([(v,) for v in values], "seq bigint")
    got = scan.dense_sequence(df, "seq", "n", width=100)
    assert rows(got) == sorted(((v, i + 1) for i, v in enumerate(sorted(values))), key=repr)


def test_dense_sequence_crosses_superblocks(spark, rows):
    values = [1, 5, 10 ** 6, 10 ** 6 + 1, 10 ** 9, 10 ** 9 + 7]
    df = spark.createDataFrame([(v,) for v in values], "seq bigint")
    assert rows(scan.dense_sequence(df, "seq", "n", width=10)) == sorted(
        ((v, i + 1) for i, v in enumerate(values)), key=repr)


def test_sorted_scan_on_doubles(spark, rows):
    values = [random.Random(3).random() for _ in range(1000)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    got = scan.sorted_scan(df, ["k"], ["v"], [scan.Running("rn", F.lit(1).cast("bigint"))])
    assert [r["rn"] for r in got.orderBy("v").collect()] == list(range(1, 1001))


def _islands(times, gap):
    out, start, last = {}, None, None
    for t in sorted(set(times)):
        if last is None or t - last > gap:
            start = t
        out[t] = start
        last = t
    return out


def test_time_islands_with_and_without_key(spark, rows):
    r = random.Random(4)
    data = [(r.choice("ab"), r.randrange(20_000)) for _ in range(1500)]
    df = spark.createDataFrame(data, "key string, us bigint")
    plain = _islands([t for _, t in data], 20)
    assert rows(scan.time_islands(df, "us", 20, width=500), "us", "island") == sorted(
        ((t, plain[t]) for _, t in data), key=repr)
    keyed = {k: _islands([t for x, t in data if x == k], 40) for k in "ab"}
    assert rows(scan.time_islands(df, "us", 40, ["key"], width=500), "key", "us", "island") == sorted(
        ((k, t, keyed[k][t]) for k, t in data), key=repr)
