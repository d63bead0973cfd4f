import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import history, matching, replay
from flowloom.plans import merge
from flowloom.schemas import MERGED_FIELDS, SCORING_FIELDS
from flowloom.session import stored
from tests import models

FLOW = ("seq bigint, proto string, saddr string, sport bigint, daddr string, dport bigint, ltime bigint, stime bigint")
LOG = ("seq bigint, zeek_log string, proto string, orig_h string, orig_p bigint, resp_h string, resp_p bigint, "
       "service string, trans_depth bigint, response_body_len bigint, user_name string, password string, command string")


def flow(seq, proto="tcp", sport=1, dport=2, saddr="s", daddr="d", ltime=7):
    return (seq, proto, saddr, sport, daddr, dport, ltime, ltime)


def log(seq, kind="conn", proto="tcp", orig_p=1, resp_p=2, service=None, depth=None, length=None, user=None,
        password=None, command=None):
    return (seq, kind, proto, "s", orig_p, "d", resp_p, service, depth, length, user, password, command)


# One run per mode serves every trace: traces differ in source address and second.
TRACES = {
    "http": ([flow(3), flow(5)], [log(1, "http", depth=1, length=100), log(2, "http", depth=3, length=50),
                                  log(4, "http", depth=0, length=7)]),
    "ftp": ([flow(1)], [log(2, "ftp", user="u", password="p", command="USER"),
                        log(3, "ftp", user=" ", password="p", command="RETR"),
                        log(4, "ftp", user="u", password="p", command=" "), log(5)]),
    "icmp": ([flow(1, "icmp", 8, 0)], [log(2, proto="icmp", orig_p=3, resp_p=1)]),
    "other": ([flow(1, "arp"), flow(2, "ARP")], []),
    "history": ([flow(i, "arp") for i in range(1, 103)], []),
}


@pytest.fixture(params=["set", "replay"], scope="module")
def merged(request, spark):
    flows, logs = [], []
    for i, (name, (a, z)) in enumerate(TRACES.items()):
        flows += [(1000 * i + r[0], *r[1:2], name, r[3], name, r[5], i, i) for r in a]
        logs += [(1000 * i + r[0], *r[1:3], name, r[4], name, *r[6:]) for r in z]
    df = merge.merge_flows(spark.createDataFrame(flows, FLOW), spark.createDataFrame(logs, LOG), mode=request.param)
    got = df.orderBy("merge_seq").collect()
    return lambda name: [r for r in got if r.saddr == name]


def _match(spark, flows, logs):
    return matching.match_sensors(spark.createDataFrame(flows, FLOW), spark.createDataFrame(logs, LOG))


def test_first_in_first_out(spark, rows):
    m = _match(spark, [flow(1), flow(2)], [log(3), log(4), log(5)])
    assert rows(m.merges, "a_seq", "z_seq") == [(1, 3), (2, 4)]
    assert rows(m.unmatched_logs) == [(5,)] and rows(m.unmatched_flows) == []


def test_log_first(spark, rows):
    m = _match(spark, [flow(2), flow(3)], [log(1)])
    assert rows(m.merges, "a_seq", "z_seq", "merge_seq") == [(2, 1, 2)]
    assert rows(m.unmatched_flows) == [(3,)]


def test_http_rows_fold_into_the_next_flow(merged):
    got = merged("http")
    assert [(r.merge_seq, r.trans_depth, r.response_body_len, r.ct_flw_http_mthd, r.service) for r in got] == [
        (3, 3, 150, 1, "http"), (5, 0, 7, 2, "http")]


def test_ftp_rows_share_a_waiting_flow(merged):
    got = merged("ftp")
    assert [r.ct_ftp_cmd for r in got] == [1, 2, 2, 0]
    assert [r.is_ftp_login for r in got] == [1, 0, 1, 0]
    assert [r.service for r in got] == ["ftp", "ftp", "ftp", "-"]


def test_icmp_ignores_ports(merged):
    assert len(merged("icmp")) == 1


def test_other_protocols_pass_through(merged):
    got = merged("other")
    assert [r.service for r in got] == [None, None]
    assert (got[1].ct_src_ltm, got[1].ct_srv_src) == (1, 0)


def test_history_is_bounded(merged):
    got = merged("history")
    assert got[49].ct_dst_ltm == 49 and got[101].ct_dst_ltm == 100


def test_layout_and_scoring_line(spark):
    df = merge.merge_flows(spark.createDataFrame([flow(1, "arp")], FLOW), spark.createDataFrame([log(2)], LOG))
    assert df.columns == ["merge_seq", *MERGED_FIELDS]
    line = merge.scoring_lines(df).first()["line"].split(",")
    assert len(line) == len(SCORING_FIELDS) == 41
    values = dict(zip(SCORING_FIELDS, line))
    assert values["ct_state_ttl"] == "" and values["spkts"] == "" and values["proto"] == "arp"


@pytest.mark.parametrize("seed", [0, 1])
def test_set_form_with_a_hot_key(spark, rows, seed, monkeypatch):
    events = models.random_events(seed)
    frame = models.events_frame(spark, events)
    monkeypatch.setattr(matching, "timeline", lambda a, z: frame)
    got = matching.match_sensors(None, None, width=97)
    assert sorted(rows(got.merges, *models.MERGE_VIEW)) == models.matched_set(events)


@pytest.mark.parametrize("seed", [0, 1])
def test_replay_equals_the_live_loop(spark, rows, seed, monkeypatch):
    events = models.random_events(seed)
    frame = models.events_frame(spark, events)
    monkeypatch.setattr(replay, "timeline", lambda a, z: frame)
    assert sorted(rows(replay.replay_merges(None, None, width=97), *models.MERGE_VIEW)) == models.replay(events)


@pytest.mark.parametrize("kinds", ["tcp conn ftp", "tcp ftp ftp ftp http", "tcp tcp dgram ftp http conn conn", "ftp conn http", "dgram ftp"])
def test_replay_of_a_hot_ftp_key(spark, rows, kinds, monkeypatch):
    """Long and short runs of ftp records, some waiting and some not, over several blocks of one key."""
    r = random.Random(kinds)
    events = models.random_events(3, n=900, hot=0.7)
    for e in events:
        e["kind"] = e["service"] = r.choice(kinds.split())
        e["is_ftp_login"], e["has_command"] = r.randrange(2), r.randrange(2)
    frame = models.events_frame(spark, events)
    monkeypatch.setattr(replay, "timeline", lambda a, z: frame)
    got = replay.replay_merges(None, None, width=61)
    assert sorted(rows(got, *models.MERGE_VIEW)) == models.replay(events)


def test_runs_of_ftp_records_pass_as_one_row(spark):
    """What meets by key alone holds a row per run, whatever the number of its records."""
    events = [{**e, "key": "tcp|0", "kind": "ftp" if i % 300 else "tcp"} for i, e in enumerate(models.random_events(1, n=900))]
    ranked = matching.ranked_timeline(replay.log_numbers(models.events_frame(spark, events)), 100)
    peaked = ranked.withColumn("peak", F.lit(0).cast("bigint"))
    before = peaked.where("kind = 'ftp'").count()
    assert before == 897 and peaked.where("kind = 'ftp'").select("key", "peak", "conns_seen").distinct().count() == 1
    decided = replay.ftp_decisions(peaked, 100)
    assert decided.where("kind = 'ftp'").count() == before and decided.where("kind = 'ftp' and waits").count() == before


@pytest.mark.parametrize("kinds", ["tcp http", "tcp tcp dgram ftp http conn conn"])
def test_peaks_of_a_timeline(spark, rows, kinds):
    """The largest lead of flows over http records before each row, also where a block begins with an open flow."""
    r = random.Random(kinds)
    events = [{**e, "kind": r.choice(kinds.split())} for e in models.random_events(5, n=600, hot=0.7)]
    got = matching.ranked_timeline(replay.log_numbers(models.events_frame(spark, events)), 23, peaks=True)
    want, state = [], {}
    for e in sorted(events, key=lambda e: e["seq"]):
        lead, peak, pending = state.get(e["key"], (0, 0, False))
        want.append((e["seq"], peak))
        if e["kind"] == "http":
            lead, pending = lead - 1, True
        elif e["kind"] == "tcp" and pending:
            pending = False
        elif e["kind"] in ("tcp", "dgram"):
            lead += 1
            peak = max(peak, lead)
        state[e["key"]] = (lead, peak, pending)
    assert rows(got, "seq", "peak") == sorted(want, key=repr)


def test_replay_computes_no_intermediate_twice(spark, monkeypatch):
    """A reliable checkpoint runs the last stage of its frame a second time to write it."""
    events = models.random_events(2, n=50)
    frame = models.events_frame(spark, events)
    monkeypatch.setattr(replay, "timeline", lambda a, z: frame)

    def twice(*args):
        raise AssertionError("a stage would run twice")
    monkeypatch.setattr(type(frame), "checkpoint", twice)
    assert replay.replay_merges(None, None, width=11).count() == len(models.replay(events))


def test_untyped_columns_are_kept_when_stored(spark):
    got = stored(spark.range(3).withColumn("nothing", F.lit(None)))
    assert got.dtypes == [("id", "bigint"), ("nothing", "void")] and got.count() == 3


@pytest.mark.parametrize("same_second", [True, False])
def test_counters_equal_a_deque(spark, rows, same_second):
    r = random.Random(5)
    data = [{"n": i + 1, "service": r.choice(["-", "-", "http", None]), "saddr": r.choice("ab"), "daddr": r.choice("xyz"),
             "sport": r.randrange(3), "dport": r.randrange(3), "ltime": i // 150} for i in range(900)]
    df = spark.createDataFrame([tuple(d.values()) for d in data],
                               "n bigint, service string, saddr string, daddr string, sport bigint, dport bigint, ltime bigint")
    got = history.connection_counters(df, "n", same_second, block=128)
    assert sorted(rows(got, "n", *history.COUNTERS)) == models.counters(data, same_second)


def test_fifo_match_keeps_leftovers(spark, rows):
    a = spark.createDataFrame([("k", 1), ("k", 2)], "key string, a_seq bigint")
    z = spark.createDataFrame([("k", 3), ("j", 4)], "key string, z_seq bigint")
    assert rows(matching.fifo_match(a, z, how="full"), "a_seq", "z_seq") == [(1, 3), (2, None), (None, 4)]
