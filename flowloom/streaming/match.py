"""Two-sensor merge as a keyed stateful stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from flowloom.functions import enrich
from flowloom.functions.keys import flow_key, log_key
from flowloom.operators.matching import MATCHED_PROTOCOLS, lower_proto
from flowloom.operators.replay import LOG_COLUMNS, KeyReplay

# {seq} is the type of the arrival numbers: integers, or places of file lines and queue records
OUTPUT = ("status string, merge_seq {seq}, a_seq {seq}, z_seq {seq}, kind string, key string, service string, "
          "trans_depth bigint, response_body_len bigint, ct_flw_http_mthd bigint, is_ftp_login int, "
          "ct_ftp_cmd bigint, payload string")
_OUTPUT_NAMES = [f.split()[0] for f in OUTPUT.split(", ")]
# Waiting rows pass between worker and state store one call each, whatever their size, so many are one text.
QUEUE_ROWS = 256
_QUEUE_STATE = "rows string"
_COUNTER_STATE = ("pending boolean, length bigint, depth bigint, last {seq}, at bigint, http bigint, ftp bigint, "
                  "clock bigint")


def stream_events(flows: DataFrame, logs: DataFrame, timed: bool = False) -> DataFrame:
    """Both sensors as one keyed stream; a flow travels whole as JSON. ``timed`` adds the event time ``at``."""
    proto = lower_proto()
    a = flows.where(proto.isin(MATCHED_PROTOCOLS)).select(
        flow_key().alias("key"), "seq", F.when(proto == "tcp", "tcp").otherwise("dgram").alias("kind"),
        F.to_json(F.struct(*flows.columns)).alias("payload"),
        *([F.timestamp_micros("stime_us").alias("at")] if timed else []))
    kind = F.lower("zeek_log")
    z = logs.select(
        log_key().alias("key"), "seq", kind.alias("kind"), enrich.service_name(kind, F.col("service")).alias("service"),
        F.coalesce("trans_depth", F.lit(0)).cast("bigint").alias("trans_depth"),
        F.coalesce("response_body_len", F.lit(0)).cast("bigint").alias("response_body_len"),
        enrich.ftp_login(F.col("user_name"), F.col("password")).cast("bigint").alias("is_ftp_login"),
        enrich.ftp_command_present(F.col("command")).cast("bigint").alias("has_command"),
        *([F.timestamp_micros("ts_us").alias("at")] if timed else []))
    both = a.unionByName(z, allowMissingColumns=True)
    return both.fillna(0, ["trans_depth", "response_body_len", "is_ftp_login", "has_command"])


class MatchProcessor(StatefulProcessor):
    """Keeps the queues, the http accumulator and the counters of one flow key.

    With ``ttl_ms`` set, rows still waiting after that time leave the state and come out
    as ``lost_flow`` / ``lost_log``. Without it, rows wait for ever; no queue has a size limit.
    """

    def __init__(self, ttl_ms: int | None = None, seq: str = "bigint"):
        self.ttl_ms, self.seq = ttl_ms, seq

    def init(self, handle) -> None:
        self.handle = handle
        self.flows = handle.getListState("flows", _QUEUE_STATE)
        self.logs = handle.getListState("logs", _QUEUE_STATE)
        self.counters = handle.getValueState("counters", _COUNTER_STATE.format(seq=self.seq))

    def _load(self) -> KeyReplay:
        machine = KeyReplay()
        machine.clock = None
        machine.flows.extend((r[0], tuple(r[1:])) for r in self._read(self.flows))
        machine.logs.extend((r[0], r[1], tuple(r[2:])) for r in self._read(self.logs))
        machine.known = [(len(q), q[0] if q else None) for q in (machine.flows, machine.logs)]
        kept = self.counters.get()
        if kept is not None:
            pending, length, depth, last, at, machine.http_merges, machine.ftp_commands, machine.clock = kept
            machine.pending = (length, depth, last, at) if pending else None
        return machine

    def _store(self, machine: KeyReplay) -> None:
        for state, queue, (n, head) in zip((self.flows, self.logs), (machine.flows, machine.logs), machine.known):
            # rows enter behind and leave in front: while the head stays, only what is behind the known ones is new
            kept = n if queue and queue[0] is head else 0
            if kept != len(queue):
                self._write(state, [[*row[:-1], *row[-1]] for row in islice(queue, kept, None)], kept > 0)
            elif n and not queue:
                state.clear()
        self.counters.update((machine.pending is not None, *(machine.pending or (0, 0, None, None)),
                              machine.http_merges, machine.ftp_commands, machine.clock))

    @staticmethod
    def _read(state) -> Iterator[list]:
        for (rows,) in state.get():
            yield from json.loads(rows)

    @staticmethod
    def _write(state, rows: list, append: bool) -> None:
        texts = [(json.dumps(rows[k:k + QUEUE_ROWS]),) for k in range(0, len(rows), QUEUE_ROWS)]
        (state.appendList if append else state.put)(texts)

    def _schedule(self, machine: KeyReplay, now: int) -> None:
        if self.ttl_ms is not None and (machine.flows or machine.logs) and not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # rows of one key in one micro-batch (bounded by the source's rate limit), in arrival order
        batch = pd.concat(list(rows)).sort_values("seq")
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else 0
        machine, out = self._load(), []
        for row in self._rows(batch):
            self._step(machine, key[0], row, now, out)
        self._store(machine)
        self._schedule(machine, now)
        yield from self._frame(out)

    @staticmethod
    def _rows(batch: pd.DataFrame, *more: str) -> Iterator[tuple]:
        return zip(*[batch[c].tolist() for c in ["seq", "kind", "payload", *LOG_COLUMNS, *more]])

    @staticmethod
    def _step(machine: KeyReplay, key: str, row: tuple, at: int, out: list) -> None:
        merged = machine.step(row[0], row[1], (row[2], at), (*row[3:], at))
        if merged is not None:
            out.append(("merged", *merged[:4], key, *merged[4:11]))

    @staticmethod
    def _evict(machine: KeyReplay, key: str, out: list, due) -> None:
        """Move the oldest rows of both queues to the output while they are due."""
        while machine.flows and due(machine.flows[0][1][1]):
            seq, (payload, _) = machine.flows.popleft()
            out.append(("lost_flow", None, seq, None, None, key, None, 0, 0, 0, 0, 0, payload))
        while machine.logs and due(machine.logs[0][2][-1]):
            seq, kind, log = machine.logs.popleft()
            out.append(("lost_log", None, None, seq, kind, key, log[0], log[1], log[2], 0, log[3], 0, None))

    @staticmethod
    def _frame(out: list) -> Iterator[pd.DataFrame]:
        """The rows of a call as one frame, none where there are none; whole numbers beside nulls stay objects."""
        if out:
            yield pd.DataFrame({name: np.array(values, object) for name, values in zip(_OUTPUT_NAMES, zip(*out))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        machine, out = self._load(), []
        self._evict(machine, key[0], out, lambda at: at + self.ttl_ms <= now)
        self._store(machine)
        self._schedule(machine, now)
        yield from self._frame(out)

    def close(self) -> None:
        pass


class EventTimeProcessor(MatchProcessor):
    """Lets rows, the http accumulator and the counters of a key expire by event time.

    The clock of a key is the latest event time among its arrivals. A row that waits is lost once the
    clock, or the watermark, has gone ``ttl_ms`` beyond its time; so is an accumulator ``ttl_ms`` after its last http
    record. An arrival ``ttl_ms`` or more after the clock finds nothing left, counters included. What matches therefore
    depends on the arrivals alone: not on micro-batches, restarts or the speed of the machine, as long as no row is later
    than the watermark's delay, for Spark drops those before they get here. The watermark only brings out lost rows and
    frees the state of keys that have gone quiet. A row without a time takes the clock's.
    """

    def _expire(self, machine: KeyReplay, key: str, now: int, out: list) -> None:
        def due(at):
            return at is not None and at + self.ttl_ms <= now
        self._evict(machine, key, out, due)
        if machine.pending is not None and due(machine.pending[3]):
            machine.pending = None

    def _wake(self, machine: KeyReplay) -> None:
        """One timer: for the oldest row that waits, else for the end of the key."""
        if machine.clock is None:
            return
        heads = [q[0][k][-1] for q, k in ((machine.flows, 1), (machine.logs, 2)) if q]
        at = min([machine.clock, *(h for h in heads if h is not None)]) + self.ttl_ms
        timers = list(self.handle.listTimers())
        if at not in timers:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        millis = batch["at"].map(lambda t: None if pd.isna(t) else t.value // 1_000_000).astype("Int64")
        machine, out = self._load(), []
        for *row, at in self._rows(batch.assign(millis=millis), "millis"):
            if at is not pd.NA and at is not None:
                if machine.clock is not None and machine.clock + self.ttl_ms <= at:
                    self._evict(machine, key[0], out, lambda _: True)
                    machine.pending, machine.http_merges, machine.ftp_commands = None, 0, 0
                machine.clock = max(at, at if machine.clock is None else machine.clock)
                self._expire(machine, key[0], machine.clock, out)
                at = int(at)
            else:
                at = machine.clock
            self._step(machine, key[0], tuple(row), at, out)
        self._store(machine)
        self._wake(machine)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        machine, out = self._load(), []
        self._expire(machine, key[0], now, out)
        if machine.clock is not None and machine.clock + self.ttl_ms <= now:
            self._evict(machine, key[0], out, lambda _: True)
            for state in (self.flows, self.logs, self.counters):
                state.clear()
        else:
            self._store(machine)
            self._wake(machine)
        yield from self._frame(out)


def stream_match(flows: DataFrame, logs: DataFrame, ttl_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """Merged rows (and, with a TTL, expired ones) of two streams with a ``seq`` column each.

    ``seq`` is an integer or a place (see ``sources.arrival``), of one type on both sides. Only flows of matched
    protocols enter; others need no state (see ``stream_other``). The TTL is processing time, or event time
    where ``delay``, the watermark's, is given (``"10 minutes"``): flows then need ``stime_us``, logs ``ts_us``.
    """
    seq = flows.schema["seq"].dataType.simpleString()
    events, processor = stream_events(flows, logs, delay is not None), MatchProcessor
    if delay is not None:
        if ttl_ms is None:
            raise ValueError("expiry by event time needs a time to live")
        events, processor = events.withWatermark("at", delay), EventTimeProcessor
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor(ttl_ms, seq), outputStructType=OUTPUT.format(seq=seq), outputMode="append",
        timeMode="EventTime" if delay is not None else "ProcessingTime" if ttl_ms is not None else "None")


def stream_other(flows: DataFrame) -> DataFrame:
    """Flows of other protocols in the layout of :func:`stream_match`."""
    zero = F.lit(0).cast("bigint")
    nothing = F.lit(None)
    return flows.where(~lower_proto().isin(MATCHED_PROTOCOLS)).select(
        F.lit("merged").alias("status"), F.col("seq").alias("merge_seq"), F.col("seq").alias("a_seq"),
        nothing.cast(flows.schema["seq"].dataType).alias("z_seq"), F.lit("other").alias("kind"), nothing.cast("string").alias("key"),
        nothing.cast("string").alias("service"), zero.alias("trans_depth"), zero.alias("response_body_len"),
        zero.alias("ct_flw_http_mthd"), F.lit(0).alias("is_ftp_login"), zero.alias("ct_ftp_cmd"),
        F.to_json(F.struct(*flows.columns)).alias("payload"))


def stream_merge(flows: DataFrame, logs: DataFrame, ttl_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """All merged rows of both sensors."""
    return stream_match(flows, logs, ttl_ms, delay).unionByName(stream_other(flows))


def unpack(merged: DataFrame, flow_schema) -> DataFrame:
    """Flow columns out of the payload, enrichment columns beside them."""
    keep = [c for c in merged.columns if c != "payload"]
    rows = merged.select(*keep, F.from_json("payload", flow_schema).alias("__f"))
    own = set(keep)
    return rows.select(*keep, *[f"__f.{f.name}" for f in flow_schema if f.name not in own]).withColumn(
        "is_sm_ips_ports", enrich.same_endpoint())
