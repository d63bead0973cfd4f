import json

import pytest
from pyspark.sql import functions as F

from flowloom.operators import categories, dataset, evaluation, timematch
from flowloom.schemas import FLOW_FIELDS, LABELLED_FIELDS, PROTO_LABELS, STATE_LABELS
from flowloom.sources import arrival, flows as src
from flowloom.sources import sinks
from flowloom.streaming import sources as streams


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def _flow_line(**given):
    values = {"stime": "2.5", "proto": "tcp", "saddr": "10.0.0.1", "sport": "0x50", "daddr": "10.0.0.2", "dport": "443",
              "state": "FIN", "ltime": "3.5", **given}
    return ",".join(values.get(f, "1") for f in FLOW_FIELDS)


def test_flow_csv(spark, tmp_path):
    text = "\n".join([",".join(FLOW_FIELDS), _flow_line(), _flow_line(proto="man", stime="x")]) + "\n"
    got = src.normalize_flows(src.read_flow_csv(spark, _write(tmp_path / "a.csv", text))).collect()
    # the header goes; a row with an unreadable time is data
    assert sorted(str(r.stime) for r in got) == ["2", "None"]
    got = [r for r in got if r.stime is not None]
    r = got[0]
    assert (r.stime, r.stime_us, r.ltime, r.sport, r.dport, r.spkts, r.dur) == (2, 2_500_000, 4, 80, 443, 1, 1.0)


def test_capture_filter_and_time_guard(spark, rows):
    df = spark.createDataFrame([("man", 1), ("LLC", 2), ("tcp", 3), (None, None)], "proto string, stime int")
    assert rows(src.captured(df), "stime") == [(3,), (None,)]
    assert rows(src.timed(df, "stime"), "stime") == [(1,), (2,), (3,)]


def test_folder_of_csv_is_one_union(spark, tmp_path):
    head = ",".join(LABELLED_FIELDS)
    row = ",".join("1" if f not in ("proto",) else "tcp" for f in LABELLED_FIELDS)
    _write(tmp_path / "d" / "a.csv", f"{head}\n{row}\n")
    _write(tmp_path / "d" / "b.csv", f"{head.upper()}\n{row}\n{row}\n")
    df = src.read_labelled_csv(spark, str(tmp_path / "d"))
    assert df.count() == 3 and df.columns == LABELLED_FIELDS and dict(df.dtypes)["label"] == "int"
    assert src.read_labelled_csv(spark, str(tmp_path / "d"), infer=True).count() == 3


def test_replaced_header_skips_only_long_rows(spark, tmp_path):
    names = ["sport", "proto", "dur", "label"]
    path = _write(tmp_path / "x.csv", "h1,h2,h3,h4\n1,tcp,0.5,1\n2,udp,0.5,1,9\n3,arp\n4,tcp,0.5,0,,\n5,tcp,0.5,0,1,2\n")
    got = src.read_replaced_header_csv(spark, path, names)
    assert sorted((r.sport, r.proto, r.label) for r in got.collect()) == [(1, "tcp", 1), (3, "arp", None)]
    assert sorted(r.sport for r in got.select("sport").collect()) == [1, 3]


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.read_labelled_csv(spark, str(tmp_path / "nothing"))


def test_reconciliation_inputs(spark, tmp_path, rows):
    a = _write(tmp_path / "a.jsonl", '{"Stime": "1.5"}\n\nnot json\n{"Stime": "", "stime": 2}\n{"x": 1}\n{"stime": "late"}\n')
    z = _write(tmp_path / "z.jsonl", '{"ts": 1.5}\nbroken\n{"ts": null}\n{"ts": 9}\n')
    fa, fz = src.read_flow_json(spark, a), src.read_log_json(spark, z)
    assert rows(fa, "a_us") == [(1_500_000,), (2_000_000,)]
    assert rows(fz, "z_us") == [(1_500_000,), (9_000_000,), (None,), (None,)]
    pairs = timematch.nearest_time_match(fa, fz.where("z_us is not null"), 0)
    got = timematch.match_summary(fa, fz, pairs).first()
    assert (got.total_b, got.matched, got.unmatched_b, got.invalid_b) == (4, 1, 3, 2)


def test_logs_are_normalised(spark):
    df = spark.createDataFrame([("1.5", "h", "0x10", "r", "21", '["ssl","x"]', "CONN", "u")],
                               "ts string, `id.orig_h` string, `id.orig_p` string, `id.resp_h` string, `id.resp_p` string, "
                               "service string, zeek_log string, user string")
    r = src.normalize_logs(df).first()
    assert (r.orig_h, r.orig_p, r.resp_p, r.service, r.zeek_log, r.ts_us, r.user_name) == (
        "h", 16, 21, "ssl", "conn", 1_500_000, "u")


def test_log_union_fills_absent_columns(spark, rows):
    both = src.union_logs({"conn": spark.createDataFrame([("ssl",)], "service string"),
                           "http": spark.createDataFrame([("get",)], "method string")})
    assert rows(both, "zeek_log", "service", "method") == [("conn", "ssl", None), ("http", None, "get")]


def test_range_snapshots(spark, tmp_path, rows):
    a = _write(tmp_path / "a.json", json.dumps({"prefixes": [{"ipv4Prefix": "1.0.0.0/8"}, {"ipv6Prefix": "::/8"}]}, indent=1))
    assert rows(src.read_ranges(spark, a, "gcloud", "ipv4Prefix")) == [("gcloud", "1.0.0.0/8")]
    b = _write(tmp_path / "b.json", json.dumps({"prefixes": [{"ip_prefix": "2.0.0.0/8"}]}))
    assert rows(src.read_ranges(spark, b, "aws", "ip_prefix")) == [("aws", "2.0.0.0/8")]


def test_category_maps_round_trip(spark, tmp_path):
    assert (len(PROTO_LABELS), len(set(PROTO_LABELS)), len(STATE_LABELS)) == (135, 135, 16)
    index = categories.index_frame(spark, STATE_LABELS)
    categories.save_category_map(index, str(tmp_path / "m"))
    want = {v: float(i) for i, v in enumerate(STATE_LABELS)}
    assert categories.category_map(categories.load_category_map(spark, str(tmp_path / "m"))) == want
    path = _write(tmp_path / "map.json", categories.category_json(STATE_LABELS))
    assert categories.category_map(categories.load_category_map(spark, path)) == want


def test_category_index_order(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert rows(categories.fit_category_index(df, "v"), "value", "index") == [("a", 1.0), ("b", 2.0), ("c", 0.0)]
    probe = spark.createDataFrame([("c",), ("zz",), (None,)], "v string")
    index = categories.fit_category_index(df, "v")
    assert rows(categories.apply_category_index(probe, "v", index), "v_index") == [(0.0,), (3.0,), (3.0,)]


def test_run_sinks_replace_their_own_run(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    for run in ("r1", "r2", "r1"):
        sinks.write_run_jsonl(df, str(tmp_path / "j"), run)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_unmatched(df, df, str(tmp_path / "lost"), "r1")
    assert spark.read.json(str(tmp_path / "lost" / "logs")).count() == 1


def test_text_sinks(spark, tmp_path):
    scored = spark.createDataFrame([("a", 1, "b", 2, 0.9, None), ("c", 1, "d", 2, 0.9, "AWS"), ("e", 1, "f", 2, 0.1, None)],
                                   "saddr string, sport int, daddr string, dport int, probability double, reason string")
    for _ in range(2):
        sinks.append_alerts(scored, str(tmp_path / "alerts"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "alerts")).collect()] == ["a:1 -> b:2"] * 2
    sinks.write_csv(scored, str(tmp_path / "c"), {"saddr": "source"})
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns[0] == "source"


def test_report_text(spark, tmp_path):
    df = spark.createDataFrame([(0, 0)] * 8 + [(1, 1)] * 3 + [(1, 0)], "label int, prediction int")
    report = evaluation.classification_report(evaluation.confusion_matrix(df))
    sinks.write_report(report, evaluation.accuracy(df), "run 1", str(tmp_path / "r"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[0] == "run 1" and lines[1] == "test accuracy: 91.67%" and lines[2] == "accuracy on attack rows: 75.00%"
    assert [x.split()[0] for x in lines[4:]] == ["Normal", "Attack", "accuracy", "macro", "weighted"]


def test_name_drift(spark):
    df = spark.createDataFrame([(1, 2, 3)], "srcip int, dsport int, Stime int")
    assert dataset.canonical_names(df).columns == ["saddr", "dport", "stime"]


def test_metrics_are_observed(spark):
    from pyspark.sql import Observation
    seen = Observation("read")
    # an Observation binds a manager to its session that fitted models cannot ship with
    spark.newSession().range(7).observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get == {"rows": 7}


def test_rows_with_unreadable_times_stay(spark, rows):
    texts = spark.createDataFrame([("stime", "proto"), ("1.5", "tcp"), ("n/a", "udp"), (None, "icmp")], "stime string, proto string")
    assert rows(src.without_header(texts), "proto") == [("icmp",), ("tcp",), ("udp",)]


def test_numbers_follow_file_order(spark, tmp_path):
    for name, lines in (("b", ["3", "4"]), ("a", ["1", "2"]), ("c", ["5"])):
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    got = src.numbered(spark.read.text(str(tmp_path)), "n").orderBy("n")
    assert [r["value"] for r in got.collect()] == ["1", "2", "3", "4", "5"]


def test_joint_arrival_is_unique(spark):
    a = spark.createDataFrame([(10, 1, "x"), (30, 2, "y"), (30, 3, "z")], "t bigint, line bigint, v string")
    z = spark.createDataFrame([(10, 1, "p"), (20, 1, "q")], "ts bigint, line bigint, v string")
    left, right = src.joint_arrival(a, z, ["t", "line"], ["ts", "line"])
    got = sorted([(r.seq, r.v) for r in left.collect()] + [(r.seq, r.v) for r in right.collect()])
    assert got == [(1, "x"), (2, "p"), (3, "q"), (4, "y"), (5, "z")]


def test_joint_arrival_keeps_rows_with_equal_order(spark):
    """Equal times and ties, null times and repeated rows: every row once, one number each."""
    a = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (1, 1, "y"), (None, 2, "n"), (5, 1, "z")], "t bigint, line bigint, v string")
    z = spark.createDataFrame([(1, 1, "p"), (1, 1, "q"), (None, None, "r")], "ts bigint, line bigint, w string")
    left, right = src.joint_arrival(a, z, ["t", "line"], ["ts", "line"])
    assert left.columns == ["t", "line", "v", "seq"] and right.columns == ["ts", "line", "w", "seq"]
    first, second = ({r.seq: r for r in df.collect()} for df in (left, right))
    assert sorted([*first, *second]) == list(range(1, 9))
    assert [first[k].v for k in sorted(first)][:1] == ["n"] and [r.v for r in first.values()].count("y") == 2
    # nulls, then flows of a time before its log records
    assert first[1].v == "n" and second[2].w == "r" and {second[6].w, second[7].w} == {"p", "q"} and first[8].v == "z"


def test_lines_are_placed_by_file_time_path_and_line(spark, tmp_path, rows):
    import os
    for name, time, lines in (("b.txt", 1, 30), ("a.txt", 2, 30), ("c d.txt", 2, 3)):
        path = _write(tmp_path / "in" / name, "\n".join(f"{name} {i}" for i in range(lines)))
        os.utime(path, (time, time))
    # small splits: blocks of a file are read by several tasks
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = arrival.placed_lines(spark.read.text(str(tmp_path / "in"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.seq for r in got}) == 63
    want = [f"{n} {i}" for n, lines in (("b.txt", 30), ("a.txt", 30), ("c d.txt", 3)) for i in range(lines)]
    assert [r.value for r in sorted(got, key=lambda r: r.seq)] == want


def test_places_do_not_depend_on_how_readers_cut_files(spark, tmp_path):
    """The cut of a file follows from cores and other files read; a wave of a stream and the batch must agree."""
    _write(tmp_path / "in" / "a.txt", "\n".join(f"line {i}" for i in range(40)))
    want = {r.value: r.seq for r in arrival.placed_lines(arrival.line_session(spark).read.text(str(tmp_path / "in"))).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        text = arrival.line_session(spark).readStream.text(str(tmp_path / "in"))
        (arrival.placed_lines(text).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
        flow_lines = _write(tmp_path / "flows" / "a.csv", "\n".join([_flow_line()] * 3))
        starts = {r.seq.split(" ")[2] for r in src.read_flow_lines(spark, flow_lines).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.value: r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert len(want) == 40 and starts == {"0" * 16}


def test_queue_records_are_placed_over_topics_and_partitions(spark):
    records = [(b"m", 5, "t", 0, 9), (b"k", 5, "t", 0, 10), (b"a", 5, "s", 1, 9), (b"z", 1, "t", 1, 700), (b"n", None, "t", 2, 0)]
    df = spark.createDataFrame(records, "value binary, at bigint, topic string, partition int, offset bigint").selectExpr(
        "value", "timestamp_micros(at) as timestamp", "topic", "partition", "offset")
    got = sorted(arrival.placed_records(df).collect(), key=lambda r: r.seq)
    assert [r.value for r in got] == ["n", "z", "a", "m", "k"] and len({r.seq for r in got}) == 5


def test_queue_rows_round_trip(spark):
    df = spark.createDataFrame([("k", 1, None), (None, 2, "x")], "key string, n int, note string")
    got = arrival.queue_rows(df, "key")
    assert [json.loads(r.value) for r in got.collect()] == [{"key": "k", "n": 1, "note": None}, {"key": None, "n": 2, "note": "x"}]
    assert [r.key for r in got.collect()] == ["k", None]


def test_queued_records_become_flows_and_logs(spark):
    records = spark.createDataFrame([(_flow_line(), "1"), (",".join(FLOW_FIELDS), "2"), (_flow_line(proto="man"), "3"), ("", "4")],
                                    "value string, seq string")
    assert [(r.seq, r.sport, r.stime_us) for r in streams.queued_flows(records).collect()] == [("1", 80, 2_500_000)]
    logs = spark.createDataFrame([('{"ts": 1, "id.orig_h": "s"}', "5"), ("# x", "6"), ("{broken", "7")], "value string, seq string")
    assert [(r.seq, r.zeek_log, r.ts_us) for r in streams.queued_logs({"conn": logs}).collect()] == [("5", "conn", 1_000_000)]
