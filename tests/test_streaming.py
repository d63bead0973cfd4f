import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowloom.catalog import fixtures
from flowloom.catalog.queries import QUERIES
from flowloom.operators import history
from flowloom.plans import scoring
from flowloom.schemas import FLOW_FIELDS, SCORING_FIELDS
from flowloom.sources import sinks
from flowloom.streaming import match, sources
from flowloom.streaming.history import HistoryBatches
from flowloom.streaming.sinks import MergeSinks, RawSink, ScoreSinks
from tests import models

EVENTS = "/root/testdata/sf0.001/events.parquet"
VIEW = ["merge_seq", "a_seq", "z_seq", "kind", "trans_depth", "response_body_len", "ct_flw_http_mthd", "is_ftp_login",
        "ct_ftp_cmd"]
FLOW = "seq bigint, proto string, saddr string, sport bigint, daddr string, dport bigint, ltime bigint"
LOG = ("seq bigint, zeek_log string, proto string, orig_h string, orig_p bigint, resp_h string, resp_p bigint, "
       "service string, trans_depth bigint, response_body_len bigint, user_name string, password string, command string")


def _as_records(events):
    """Model events as the two sensors would send them."""
    flows, logs = [], []
    for e in events:
        n = int(e["key"].split("|")[1])
        if e["kind"] == "tcp":
            flows.append((e["seq"], "tcp", "s", n, "d", 9, 0))
        else:
            logs.append((e["seq"], e["kind"], "tcp", "s", n, "d", 9, None, e["trans_depth"], e["response_body_len"],
                         "u" if e["is_ftp_login"] else "", "p", "c" if e["has_command"] else ""))
    return flows, logs


def _drop(path, names, rows, number):
    """One file per arrival batch; both folders are read in file order."""
    path.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(rows, columns=names).to_json(path / f"{number:03d}.json", orient="records", lines=True)


def _names(schema):
    return [c.split()[0] for c in schema.split(", ")]


def _merge_stream(spark, root, ttl_ms=None):
    a = spark.readStream.schema(FLOW).option("maxFilesPerTrigger", 1).json(str(root / "a"))
    z = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(root / "z"))
    return match.stream_merge(a, z, ttl_ms)


def _run(stream, root):
    (stream.writeStream.format("parquet").option("path", str(root / "out"))
     .option("checkpointLocation", str(root / "cp")).trigger(availableNow=True).start().awaitTermination())


def test_stream_equals_replay_over_batches_and_a_restart(spark, tmp_path, rows):
    events = models.random_events(3, n=240)
    # three arrival batches; the query is stopped and restarted before the last one
    for number, part in enumerate((events[:80], events[80:150], events[150:])):
        flows, logs = _as_records(part)
        _drop(tmp_path / "a", _names(FLOW), flows, number)
        _drop(tmp_path / "z", _names(LOG), logs, number)
        if number:
            _run(_merge_stream(spark, tmp_path), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(rows(got, *VIEW)) == models.replay(events)


def test_expired_rows_come_out(spark, tmp_path, rows):
    _drop(tmp_path / "a", _names(FLOW), [(1, "tcp", "s", 1, "d", 9, 0)], 0)
    _drop(tmp_path / "z", _names(LOG), [(2, "conn", "tcp", "s", 2, "d", 9, None, 0, 0, "", "", "")], 0)
    query = (_merge_stream(spark, tmp_path, ttl_ms=500).writeStream.format("memory").queryName("expired")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start())
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("expired").count() < 2:
            time.sleep(0.5)
        assert rows(spark.table("expired"), "status", "a_seq", "z_seq") == [("lost_flow", 1, None), ("lost_log", None, 2)]
    finally:
        query.stop()


def test_lost_rows_are_not_counted(spark, tmp_path, rows):
    row = "status string, merge_seq bigint, service string, saddr string, sport bigint, daddr string, dport bigint, ltime bigint"
    batch = spark.createDataFrame([("lost_flow", None, None, "s", 1, "d", 2, 0), ("merged", 5, "-", "s", 1, "d", 2, 0),
                                   ("merged", 7, "-", "s", 1, "d", 2, 0)], row)
    sink = HistoryBatches(str(tmp_path))
    sink(batch, 0)
    # a late merge follows those emitted before it
    sink(batch.where("merge_seq = 5").withColumn("merge_seq", F.lit(3).cast("bigint")), 1)
    assert rows(sink.read(spark), "n", "merge_seq", "ct_src_ltm") == [(1, 5, 0), (2, 7, 1), (3, 3, 2)]
    assert spark.read.parquet(sink.unmatched).count() == 1


def test_history_runs_the_plan_of_a_batch_once(spark, tmp_path):
    """A stateful plan is behind a batch; each further run of it costs as much as the first."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch
    row = "status string, merge_seq bigint, service string, saddr string, sport bigint, daddr string, dport bigint, ltime bigint"
    batch = spark.createDataFrame([("merged", i, "-", "s", 1, "d", 2, 0) for i in range(30)], row).mapInPandas(counted, row)
    sink = HistoryBatches(str(tmp_path))
    sink(batch, 0)
    assert seen.value == 30 and sink.read(spark).count() == 30 and not (tmp_path / "staged" / "0").exists()


def test_merge_from_files_equals_replay(spark):
    got = QUERIES["merge_from_files"](spark, "/root/testdata/sf0.001")
    assert got.count() > 500 and got.where("kind = 'http'").count() > 50


def test_merge_from_files_holds_the_rows_of_replay(spark):
    """All flows go through the files; numbered by time as there, the replay merges the same ones."""
    from flowloom.plans.merge import merge_flows
    from flowloom.sources import flows as source
    sf = "/root/testdata/sf0.001"
    a, z = source.joint_arrival(source.captured(fixtures.flows(spark, sf)).drop("seq"), fixtures.logs(spark, sf).drop("seq"),
                                ["stime_us", "stcpb"], ["ts_us", "response_body_len"])
    want = merge_flows(a, z, mode="replay").select("stcpb", "service")
    got = QUERIES["merge_from_files"](spark, sf).select("stcpb", "service")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_counters_continue_across_batches(spark, tmp_path, rows):
    a = fixtures.derive(spark.read.parquet(EVENTS), fixtures.FLOWS).select(
        F.col("seq").alias("merge_seq"), F.col("state").alias("service"), "saddr", "sport", "daddr", "dport", "ltime")
    sink = HistoryBatches(str(tmp_path))
    edges = [0, 700, 705, 2500, 10 ** 9]
    for number, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = a.where(F.col("merge_seq").between(lo, hi - 1))
        sink(part, number)
        if number == 1:
            sink(part, number)  # a repeated batch changes nothing
    whole = a.withColumn("n", (F.col("merge_seq") / 4 + 1).cast("bigint"))
    want = history.connection_counters(whole, "n")
    assert rows(sink.read(spark), "n", *history.COUNTERS) == rows(want, "n", *history.COUNTERS)


def test_sensor_streams_read_files(spark, tmp_path, rows):
    line = ",".join({"stime": "1.5", "ltime": "2", "proto": "tcp", "saddr": "s", "daddr": "d"}.get(f, "1") for f in FLOW_FIELDS)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text(",".join(FLOW_FIELDS) + "\n" + line + "\n")
    for kind, text in {"conn": '#fields\n\n{"ts": 1.5, "id.orig_h": "s", "proto": "tcp"}\nbroken\n',
                       "http": '{"ts": 2, "id.orig_h": "s", "trans_depth": 3}\n', "ftp": '{"ts": 3, "user": "u"}\n'}.items():
        (tmp_path / "z" / kind).mkdir(parents=True)
        (tmp_path / "z" / kind / "x.log").write_text(text)

    def drain(stream, name):
        stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)
    a = drain(sources.flow_stream(spark, str(tmp_path / "a"), 5), "flow_in")
    assert rows(a, "stime_us", "stime", "sport") == [(1_500_000, 2, 1)]
    z = drain(sources.log_stream(spark, str(tmp_path / "z"), 5), "log_in")
    assert rows(z, "zeek_log", "ts_us", "trans_depth", "user_name") == [
        ("conn", 1_500_000, None, None), ("ftp", 3_000_000, None, "u"), ("http", 2_000_000, 3, None)]


def test_scoring_lines_to_alerts(spark, tmp_path):
    def line(saddr, sbytes):
        given = {"saddr": saddr, "daddr": "d", "sport": "1", "dport": "2", "sbytes": sbytes, "stime": "5", "ct_state_ttl": ""}
        return ",".join(given.get(c, "0") for c in SCORING_FIELDS)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("\n".join([line("bad", "9"), line("good", "1"), "too,short"]) + "\n")
    rows = sources.scoring_stream(spark, str(tmp_path / "in"), 5)
    scored = rows.withColumn("probability", F.col("sbytes") / 10).withColumn("reason", F.lit(None).cast("string"))
    scored = scoring.with_latency_metrics(scored.withColumn("latency", F.col("stime")))
    query = scoring.alert_stream(scored, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True})
    query.awaitTermination()
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["bad:1 -> d:2"]
    assert sources.parse_scoring(spark.createDataFrame([("too,short",)], "line string")).first().malformed
    assert json.loads(query.lastProgress.json)["observedMetrics"]["latency"]["rows"] == 3


def test_payload_unpacks_to_the_flow(spark):
    flows = spark.createDataFrame([(1, "arp", "s", 1, "s", 1, 4)], FLOW)
    got = match.unpack(match.stream_other(flows), flows.schema).first()
    assert (got.merge_seq, got.saddr, got.ltime, got.is_sm_ips_ports, got.service) == (1, "s", 4, 1, None)


def test_unknown_mode_is_refused(spark):
    from flowloom.plans.merge import merge_flows
    with pytest.raises(ValueError):
        merge_flows(None, None, mode="other")


def test_run_sink_of_raw_stream(spark, tmp_path):
    a = fixtures.derive(spark.read.parquet(EVENTS), fixtures.FLOWS)
    sinks.write_run_jsonl(a, str(tmp_path / "raw"), "r1")
    assert spark.read.json(str(tmp_path / "raw")).count() == a.count()


def _held(spark, path, sinks_of_run):
    return {sink: sorted(r[0] for r in spark.read.text(f"{path}/{sink}").select("value").collect()) for sink in sinks_of_run}


def test_merge_sinks_route_rows_and_repeat_a_batch(spark, tmp_path):
    """Merged, lost and other rows in two batches; the second is given twice and leaves what it left once."""
    flow = spark.read.parquet(EVENTS).transform(lambda e: fixtures.derive(e, fixtures.FLOWS))
    others = match.stream_other(flow)
    lost_flow = others.limit(1).withColumns({"status": F.lit("lost_flow"), "payload": F.lit('{"seq":5,"proto":"tcp"}')})
    lost_log = others.limit(1).withColumns({"status": F.lit("lost_log"), "z_seq": F.lit(9).cast("bigint"), "kind": F.lit("ftp"),
                                            "payload": F.lit(None).cast("string")})
    middle = flow.count() * 2
    first = others.where(F.col("merge_seq") < middle)
    second = others.where(F.col("merge_seq") >= middle).unionByName(lost_flow).unionByName(lost_log)
    sink, names = MergeSinks(str(tmp_path), "r1", flow.schema), ("merged", "scoring", "unmatched/flows", "unmatched/logs")
    sink(first, 0)
    sink(second, 1)
    once = _held(spark, tmp_path, names)
    sink(second, 1)
    assert _held(spark, tmp_path, names) == once
    assert len(once["merged"]) == len(once["scoring"]) == others.count() > 0
    assert once["unmatched/flows"] == ['{"seq":5,"proto":"tcp"}']
    assert [json.loads(x)["z_seq"] for x in once["unmatched/logs"]] == [9]
    merged = [json.loads(x) for x in once["merged"]]
    assert all(len(m) == 45 for m in merged)  # the number of the merge, then the 44 fields
    assert not list((tmp_path / "staged" / "run=r1").glob("batch=*"))
    # the counters of the second batch see the first
    history_rows = spark.read.parquet(sink.history.rows)
    assert sorted(r.n for r in history_rows.collect()) == list(range(1, others.count() + 1))


def test_merge_sinks_take_empty_batches(spark, tmp_path):
    flow = fixtures.derive(spark.read.parquet(EVENTS), fixtures.FLOWS)
    others, sink = match.stream_other(flow), MergeSinks(str(tmp_path), "r1", flow.schema)
    for number, rows in enumerate([others.limit(0), others, others.limit(0)]):
        sink(rows, number)
    assert len(_held(spark, tmp_path, ["merged"])["merged"]) == others.count()


def test_raw_sink_keeps_nulls(spark, tmp_path):
    RawSink(str(tmp_path), "r1", "flows")(spark.createDataFrame([(1, None)], "seq bigint, proto string"), 0)
    assert _held(spark, tmp_path, ["raw/flows"]) == {"raw/flows": ['{"seq":1,"proto":null}']}


def test_sinks_of_a_merge_are_compressed(spark, tmp_path):
    """JSON with the names of all fields in each line takes most of a run's disk."""
    flow = fixtures.derive(spark.read.parquet(EVENTS), fixtures.FLOWS)
    RawSink(str(tmp_path), "r1", "flows")(flow, 0)
    MergeSinks(str(tmp_path), "r1", flow.schema)(match.stream_other(flow), 0)
    for sink in ("raw/flows", "merged", "scoring"):
        files = [x for x in (tmp_path / sink).rglob("part-*")]
        plain = sum(len(line) + 1 for line in _held(spark, tmp_path, [sink])[sink])
        assert files and sum(x.stat().st_size for x in files) < plain / 3
    assert spark.read.json(str(tmp_path / "raw/flows")).count() == flow.count()


def test_score_sinks_part_malformed_lines(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "x", False, 0.9, None, "s", "1", "d", "2"), ("b", "y", False, 0.9, "AWS", "s", "1", "d", "3"),
         ("c", "bad,line", True, None, None, None, None, None, None)],
        "seq string, line string, malformed boolean, probability double, reason string, saddr string, sport string, "
        "daddr string, dport string")
    ScoreSinks(str(tmp_path), "r1")(rows, 0)
    assert _held(spark, tmp_path, ["alerts", "malformed"]) == {
        "alerts": ["s:1 -> d:2"], "malformed": ['{"seq":"c","line":"bad,line"}']}
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "verdicts")).collect()) == ["a", "b"]


def _expiring(spark, tmp_path, arrivals, parts, ttl=100):
    """Arrivals (kind, seq, millis or None) of one key, landed in the given parts, through the event-time merge."""
    flow = "seq bigint, stime_us bigint, proto string, saddr string, sport bigint, daddr string, dport bigint, ltime bigint"
    log = "seq bigint, ts_us bigint, zeek_log string, proto string, orig_h string, orig_p bigint, resp_h string, resp_p bigint, " \
          "service string, trans_depth bigint, response_body_len bigint, user_name string, password string, command string"
    def us(t):
        return None if t is None else (t + 10_000) * 1000
    out = str(tmp_path / "out")
    for lo, hi in zip(parts, parts[1:]):
        some = arrivals[lo:hi]
        a = [(s, us(t), "tcp", "s", 1, "d", 2, 0) for k, s, t in some if k == "tcp"]
        z = [(s, us(t), k, "tcp", "s", 1, "d", 2, None, 1, 5, "u", "p", "get") for k, s, t in some if k != "tcp"]
        spark.createDataFrame(a, flow).write.mode("append").parquet(str(tmp_path / "a"))
        spark.createDataFrame(z, log).write.mode("append").parquet(str(tmp_path / "z"))
        merged = match.stream_match(spark.readStream.schema(flow).parquet(str(tmp_path / "a")),
                                    spark.readStream.schema(log).parquet(str(tmp_path / "z")), ttl, "150 milliseconds")
        (merged.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start().awaitTermination())
    return sorted(((r.status, r.merge_seq, r.a_seq, r.z_seq, r.kind, r.ct_flw_http_mthd, r.ct_ftp_cmd)
                   for r in spark.read.parquet(out).collect()), key=repr)


ARRIVALS = [("tcp", 1, 0), ("conn", 2, 50), ("tcp", 3, 60), ("conn", 4, 170),  # the flow at 60 waits too long
            ("http", 5, 180), ("tcp", 6, 290), ("tcp", 7, 300), ("ftp", 8, 310), ("ftp", 9, None),  # accumulator and record expire
            ("http", 10, 1000), ("tcp", 11, 1001), ("conn", 12, 900),  # a quiet key starts anew; a late record keeps the clock
            ("tcp", 13, 2000)]


def test_expiry_depends_on_event_time_alone(spark, tmp_path):
    """One batch or several with restarts between them: the same rows merge, the same are lost."""
    whole = _expiring(spark, tmp_path / "one", ARRIVALS, [0, len(ARRIVALS)])
    pieces = _expiring(spark, tmp_path / "two", ARRIVALS, [0, 3, 5, 8, 11, len(ARRIVALS)])
    assert whole == pieces
    merged = [r[1:5] for r in whole if r[0] == "merged"]
    assert (2, 1, 2, "conn") in merged and (11, 11, 10, "http") in merged
    assert not any(r[1] == 3 for r in merged)
    assert ("lost_flow", 3) in [(r[0], r[2]) for r in whole]
    # the http record at 180 is too old for the flow at 290
    assert not any(r[2] == 5 for r in merged) and ("lost_log", 5) in [(r[0], r[3]) for r in whole]


class _State:
    """A state variable of one key that counts the rows which pass."""

    def __init__(self):
        self.rows, self.passed = [], 0

    def get(self):
        self.passed += len(self.rows) if isinstance(self.rows, list) else 0
        return iter(self.rows) if isinstance(self.rows, list) else self.rows

    def put(self, rows):
        self.passed += len(rows)
        self.rows = list(rows)

    def appendList(self, rows):
        self.passed += len(rows)
        self.rows += rows

    def update(self, row):
        self.rows = row

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.lists, self.value = {}, _State()
        self.value.rows = None

    def getListState(self, name, schema):
        return self.lists.setdefault(name, _State())

    def getValueState(self, name, schema):
        return self.value


def _arrivals(first, kinds):
    n = len(kinds)
    return pd.DataFrame({"seq": range(first, first + n), "kind": kinds, "payload": [f'{{"seq":{first + k}}}' for k in range(n)],
                         "service": [None] * n, **{c: [k % 3 for k in range(n)] for c in match.LOG_COLUMNS if c != "service"}})


@pytest.mark.parametrize("kinds", [[["tcp"] * 1000, ["tcp"] * 1000, ["conn"] * 300, ["ftp"] * 9 + ["conn"] * 1700, ["tcp"]],
                                   [["conn"] * 600, ["http", "conn"] * 300, ["tcp"] * 400, ["tcp", "dgram"] * 500],
                                   [["tcp", "conn"] * 500, ["ftp"] * 3, ["tcp"] * 3]])
def test_waiting_rows_pass_the_state_many_at_a_time(kinds):
    handle, machine, want, got, at = _Handle(), match.KeyReplay(), [], [], 0
    for batch in kinds:
        processor = match.MatchProcessor()
        processor.init(handle)
        rows = _arrivals(at, batch)
        at += len(batch)
        got += [r for frame in processor.handleInputRows(("k",), iter([rows]), None) for r in frame["merge_seq"].tolist()]
        want += [m[0] for r in match.MatchProcessor._rows(rows)
                 if (m := machine.step(r[0], r[1], (r[2], 0), (*r[3:], 0))) is not None]
        processor.init(handle)
        left = processor._load()
        assert list(left.flows) == list(machine.flows) and list(left.logs) == list(machine.logs)
    assert got == want
    # one state row for each waiting record had thousands pass
    assert sum(s.passed for s in handle.lists.values()) <= 100
