import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions import address, coerce, enrich
from flowloom.operators import netranges


def _column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v")).alias("x")).collect()]


def test_ports(spark):
    assert _column(spark, ["0x1F90", "80", " 80 ", "80.0", "", None, "0xZZ", "abc", "0X50"], coerce.port_number) == [
        8080, 80, 80, 0, 0, 0, 0, 0, 80]


def test_half_even_seconds(spark):
    assert _column(spark, [2.5, 3.5, 2.4999, None], coerce.half_even_seconds, "double") == [2, 4, 2, None]


def test_epochs(spark):
    got = _column(spark, ["12.5", " 7 ", "1970-01-02 00:00:01", "1970-01-01T00:00:02Z", "soon", None], coerce.epoch_seconds)
    assert got == [12.5, 7.0, 86401.0, 2.0, None, None]
    assert _column(spark, ["0.000001", "1.5"], coerce.epoch_micros) == [1, 1_500_000]


def test_lenient_numbers(spark):
    values = ["1", "x", None, "2.5"]
    assert _column(spark, values, coerce.lenient_double) == [1.0, None, None, 2.5]
    assert _column(spark, values, coerce.scoring_float) == [1.0, 0.0, 0.0, 2.5]
    assert _column(spark, values, coerce.label_int) == [1, -1, -1, 2]


def test_fill_skips_absent_columns(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", "3")], "k string, v string")
    assert rows(coerce.cast_and_fill(df, ["v", "absent"])) == [("a", -1.0), ("b", 3.0)]


def test_required_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert coerce.require_columns(df, ["b"]).columns == ["b"]
    with pytest.raises(ValueError, match="c"):
        coerce.require_columns(df, ["a", "c"])


def test_addresses(spark):
    assert _column(spark, ["0.0.0.1", "1.0.0.0", "256.1.1.1", "01.1.1.1", "fe80::1", "x", None], address.ipv4_number) == [
        1, 1 << 24, None, None, None, None, None]


def test_networks(spark):
    def bounds(c):
        return F.struct(*[b.alias(f"x{i}") for i, b in enumerate(address.network_bounds(c))])
    got = _column(spark, ["0.0.0.5/30", "0.0.0.7", "0.0.0.0/0", "0.0.0.0/33", "::/8"], bounds)
    assert [tuple(r) for r in got] == [(4, 7, 30), (7, 7, 32), (0, (1 << 32) - 1, 0), (None, None, None), (None, None, 8)]


def _brute_reason(ranges, src, dst):
    def number(ip):
        p = [int(x) for x in ip.split(".")]
        return p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]

    if address.METADATA_ADDRESS in (src, dst):
        return "Meta"
    for provider, reason in netranges.PROVIDERS:
        for p, cidr in ranges:
            base, length = cidr.split("/")
            shift = 32 - int(length)
            if p == provider and any(number(x) >> shift == number(base) >> shift for x in (src, dst)):
                return reason
    return None


@pytest.mark.parametrize("limit", [1_000_000, 0], ids=["broadcast", "shuffled"])
def test_allow_list_equals_brute_force(spark, rows, limit):
    r = random.Random(11)

    def ip():
        return f"10.{r.randrange(2)}.{r.randrange(40)}.{r.randrange(256)}"
    ranges = [(r.choice(netranges.PROVIDERS)[0], f"{ip()}/{r.randrange(14, 33)}") for _ in range(60)]
    pairs = [(i, ip(), ip()) for i in range(600)] + [(600, address.METADATA_ADDRESS, ip())]
    flows = spark.createDataFrame(pairs, "i int, saddr string, daddr string")
    got = netranges.allow_reason(flows, spark.createDataFrame(ranges, "provider string, cidr string"), broadcast_limit=limit)
    assert rows(got, "i", "reason") == sorted(((i, _brute_reason(ranges, s, d)) for i, s, d in pairs), key=repr)


def test_full_bucket_is_bisected(spark, rows):
    """Every second address of a bucket is a range of its own, so the bucket holds as many segments as it can."""
    size = netranges.BUCKET
    ranges = spark.range(0, size, 2).selectExpr(
        "case id % 4 when 0 then 'aws' else 'gcloud' end as provider",
        "concat('10.0.', cast(id div 256 as string), '.', cast(id % 256 as string)) as cidr")
    assert netranges.bucket_rows(netranges.range_segments(ranges)).selectExpr("size(lo)").collect()[0][0] == size // 2
    flows = spark.range(size + 2).selectExpr("id", "concat('10.0.', cast(id div 256 as string), '.', cast(id % 256 as string)) as saddr",
                                             "cast(null as string) as daddr")
    found = netranges.allow_reason(flows, ranges)
    expected = [(i, None if i % 2 or i >= size else "AWS" if i % 4 == 0 else "GCloud") for i in range(size + 2)]
    assert rows(found, "id", "reason") == sorted(expected, key=repr)


def test_buckets_are_texts_of_ranks(spark, rows):
    """A lookup reads one character; it neither copies arrays of segments nor calls a function per step."""
    ranges = spark.createDataFrame([("aws", "10.0.0.4/30"), ("gcloud", "10.0.0.6"), ("suse", "10.0.16.0/20"), ("aws", "10.0.0.4/30"),
                                    ("aws", "10.0.0.300/30"), ("other", "10.0.0.0/8"), ("aws", "10.0.0.0/33")], "provider string, cidr string")
    found = {r.bucket: r for r in netranges.rank_texts(netranges.range_segments(ranges)).collect()}
    first = (10 << 24) // netranges.BUCKET
    assert bytes(found[first].ranks) == (b"    2212" + b" " * netranges.BUCKET)[:netranges.BUCKET]
    assert (bytes(found[first + 1].ranks), found[first + 1].width, len(found)) == (b"5", 1, 2)
    flows = spark.createDataFrame([(1, "10.0.0.3", "10.0.0.6"), (2, "10.0.31.255", "10.0.0.7"), (3, "10.0.32.0", "10.0.0.8")], "i int, saddr string, daddr string")
    got = netranges.allow_reason(flows, ranges)
    assert rows(got, "i", "reason") == [(1, "GCloud"), (2, "AWS"), (3, None)]
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_unreadable_addresses_match_nothing(spark, rows):
    flows = spark.createDataFrame([(1, "fe80::1", "x"), (2, None, "10.0.0.1")], "i int, saddr string, daddr string")
    got = netranges.allow_reason(flows, spark.createDataFrame([("aws", "10.0.0.0/8")], "provider string, cidr string"))
    assert rows(got, "i", "reason") == [(1, None), (2, "AWS")]


def test_verdicts(spark):
    df = spark.createDataFrame([(0.6, "GCloud"), (0.7, None), (0.49, None), (0.5, None)], "p double, r string")
    p, r = F.col("p"), F.col("r")
    got = [tuple(x) for x in df.select(enrich.verdict(p, r), enrich.severity(p, r)).collect()]
    assert got == [("ignored(GCloud)", None), ("attack", "high"), ("normal", None), ("attack", "low")]


def test_latency(spark):
    now = F.lit(10.0)
    assert _column(spark, ["4", "x", None], lambda c: enrich.latency_seconds(c, now)) == [6.0, 0.0, 0.0]
    assert _column(spark, ["4", None], lambda c: enrich.latency_text(c, now)) == ["6.0000s", "N/A"]


def test_first_service(spark):
    assert _column(spark, [["ssl", "http"], [], None], enrich.first_service, "array<string>") == ["ssl", None, None]


def test_numbers_that_are_none(spark):
    got = _column(spark, ["1", "nan", "3", "2d", "inf", "", None, "1e3"], coerce.lenient_double)
    assert got == [1.0, None, 3.0, None, float("inf"), None, None, 1000.0]


def test_over_long_ports_are_zero(spark):
    assert _column(spark, ["0x1F90", "0x" + "0" * 20 + "50", "0x" + "1" * 20], coerce.port_number) == [8080, 80, 0]
