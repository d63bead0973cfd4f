"""Record-by-record form of the two-sensor merge.

Differences to the set form, all of them visible only through arrival order: http records
stay in the waiting queue after they were folded, so a later flow may still take one; an
ftp record that finds no flow waits for one; queues are first in, first out.

Let ``flows``, ``conns`` and ``https`` be the running counts of eligible flows, conn and http records
of a key, and ``peak`` the running maximum of ``flows - https`` at flows. Each arrival acts on the length of
the flow queue as ``x -> max(x + c, d)``, which adds up to ``max(peak, conns) - conns`` waiting flows
and ``max(peak, conns) + https - flows`` waiting records. An ftp record that finds a flow leaves all as it
is; one that finds none waits like a conn record. So it waits if ``peak - conns`` is no more than the number of
ftp records that wait before it: only this number depends on what came before, and ftp records with the same
``peak`` and ``conns`` decide alike. One narrow row per such run of records passes a sequential step, all else
is running counts and joins over blocks of a key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.matching import CARRIED, fold_merges, ranked_timeline, timeline
from flowloom.operators.scan import BLOCK_WIDTH, Running, block_index, keyed_scan, own_exchange
from flowloom.session import stored

MERGE_COLUMNS = ["merge_seq", "a_seq", "z_seq", "kind", "key", "service", "trans_depth", "response_body_len",
                 "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", *CARRIED]
LOG_COLUMNS = ["service", "trans_depth", "response_body_len", "is_ftp_login", "has_command"]


class KeyReplay:
    """Queues, http accumulator and counters of one flow key."""

    def __init__(self):
        self.flows: deque = deque()
        self.logs: deque = deque()
        self.pending = None  # (sum of lengths, largest depth, last seq, last of what the record carries)
        self.http_merges = 0
        self.ftp_commands = 0

    def step(self, seq: int, kind: str, carried: tuple, log: tuple):
        """Process one arrival; the merged row it causes, or ``None``."""
        if kind in ("tcp", "dgram"):
            flow = (seq, carried)
            if kind == "tcp" and self.pending is not None:
                length, depth, last, _ = self.pending
                self.pending = None
                return self._merge(seq, flow, (last, "http", ("http", depth, length, 0, 0)))
            if self.logs:
                return self._merge(seq, flow, self.logs.popleft())
            self.flows.append(flow)
            return None
        record = (seq, kind, log)
        if kind == "http":
            length, depth, *_ = self.pending or (0, 0)
            self.pending = (length + log[2], max(depth, log[1]), seq, log[-1])
        elif self.flows:
            # an ftp record leaves the flow waiting for more
            return self._merge(seq, self.flows[0] if kind == "ftp" else self.flows.popleft(), record)
        self.logs.append(record)
        return None

    def _merge(self, at: int, flow: tuple, record: tuple) -> tuple:
        z_seq, kind, (service, depth, length, login, command, *_) = record
        http = ftp = 0
        if kind == "http":
            self.http_merges += 1
            http = self.http_merges
        else:
            depth = length = 0
        if kind == "ftp":
            self.ftp_commands += command
            ftp = self.ftp_commands
        else:
            login = 0
        return (at, flow[0], z_seq, kind, service, depth, length, http, login, ftp, *flow[1])


def log_numbers(events: DataFrame) -> DataFrame:
    """Zero for what a log record does not state; flow columns keep their nulls."""
    return events.fillna(0, ["trans_depth", "response_body_len", "is_ftp_login", "has_command"])


def _runs_that_wait(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs sorted by key and arrival: a run waits if as many ftp records as its margin wait before it."""
    key, waiting = None, 0
    for batch in batches:
        out = []
        for k, margin, n in zip(*[batch[c].tolist() for c in ("key", "margin", "n")]):
            if k != key:
                key, waiting = k, 0
            out.append(waiting >= margin)
            waiting += n if out[-1] else 0
        yield batch[["key", "peak", "conns_seen"]].assign(waits=out)


def ftp_decisions(ranked: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """``ranked`` with ``waits``, null but for ftp records."""
    ftp = F.col("kind") == "ftp"
    runs = ranked.where(ftp).groupBy("key", "peak", "conns_seen").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), (F.col("peak") - F.col("conns_seen")).alias("margin"))
    # narrow: a row per run, not per record
    waits = stored(runs.repartition(own_exchange("key")).sortWithinPartitions("key", "seq").select(
        "key", "peak", "conns_seen", "n", "margin").mapInPandas(
        _runs_that_wait, "key string, peak bigint, conns_seen bigint, waits boolean"))
    decided = ranked.where(ftp).join(waits, ["key", "peak", "conns_seen"])
    return ranked.where(~ftp).unionByName(decided.select(*ranked.columns, "waits"), allowMissingColumns=True)


def queue_moves(decided: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """What each arrival does to the queues, and how often each was done up to it, in one exchange of the timeline.

    A flow waits where it raises the larger of ``peak`` and ``conns``, a record where it raises ``conns`` beyond
    ``peak``; ftp records that wait count among ``conns``. With ``kept``, the number of records that wait instead of
    taking a flow, ``max(peak, conns) - kept`` flows have waited, ``conns - kept`` of them were taken, ``https + kept``
    records have waited: only ``kept`` is summed up.
    """
    kind, group = F.col("kind"), ["key", "__blk"]
    queue_flow = kind.isin("tcp", "dgram") & ~F.col("folds")
    record = F.coalesce((kind == "conn") | F.col("waits"), F.lit(False))
    blocked = decided.withColumn("__blk", block_index("seq", width))
    past = Window.partitionBy("key").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    before = blocked.groupBy(*group).agg(F.sum(F.col("waits").cast("bigint")).alias("n")).select(
        *group, F.sum("n").over(past).alias("__ftps")).where("__ftps > 0")
    work = blocked.repartition(*group)
    upto = Window.partitionBy(*group).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = work.select(*work.columns, F.sum(F.coalesce("waits", F.lit(False)).cast("bigint")).over(upto).alias("__inside"))
    counted = inside.join(before, group, "left").withColumn(
        "conns_seen", F.col("conns_seen") + F.col("__inside") + F.coalesce("__ftps", F.lit(0))).drop("__inside", "__ftps")
    keeps = record & (F.col("peak") < F.col("conns_seen"))
    local = counted.select(*counted.columns, keeps.alias("__keeps"), F.sum(keeps.cast("bigint")).over(upto).alias("__kept"))
    carry = local.groupBy(*group).agg(F.sum(F.col("__keeps").cast("bigint")).alias("n")).select(
        *group, F.sum("n").over(past).alias("__c_kept"))
    kept = F.col("__kept") + F.coalesce("__c_kept", F.lit(0))
    # the state after this arrival: only a waiting-eligible flow moves the peak
    high = F.greatest("conns_seen", F.when(queue_flow, F.greatest("peak", F.col("flows_seen") - F.col("https_seen")))
                      .otherwise(F.col("peak")))
    raised = queue_flow & (F.col("flows_seen") - F.col("https_seen") > F.greatest("peak", "conns_seen"))
    return local.join(carry, group, "left").select(
        "key", "seq", "kind", *LOG_COLUMNS, *CARRIED, (high - kept).alias("a_push"), (F.col("conns_seen") - kept).alias("a_pop"),
        (F.col("https_seen") + kept).alias("z_push"), (F.col("flows_seen") - high + kept).alias("z_pop"),
        raised.alias("__a_push"), ((kind == "conn") & ~F.col("__keeps")).alias("__a_pop"),
        ((kind == "http") | F.col("__keeps")).alias("__z_push"), (queue_flow & ~raised).alias("__z_pop"),
        ((kind == "ftp") & ~F.col("waits")).alias("__lent"))


def replay_events(events: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Merges of a timeline: no rows of a key meet in one task but by blocks of its arrivals."""
    kind = F.col("kind")
    ranked = stored(ranked_timeline(log_numbers(events), width, peaks=True))
    queued = stored(queue_moves(ftp_decisions(ranked, width), width))

    def rows(flag, rank, seq, cols):
        return queued.where(F.col(f"__{flag}")).select("key", rank.alias("rn"), F.col("seq").alias(seq), *cols)

    log_cols = ["kind", *LOG_COLUMNS]
    waiting_flows = rows("a_push", F.col("a_push"), "a_seq", CARRIED)
    # a lent flow is the oldest that waits: the one after those taken
    askers = rows("a_pop", F.col("a_pop"), "z_seq", log_cols).unionByName(
        rows("lent", F.col("a_pop") + 1, "z_seq", log_cols))
    taken = (rows("z_pop", F.col("z_pop"), "a_seq", CARRIED)
             .join(rows("z_push", F.col("z_push"), "z_seq", log_cols), ["key", "rn"])
             .withColumn("merge_seq", F.col("a_seq")))
    given = waiting_flows.join(askers, ["key", "rn"]).withColumn("merge_seq", F.col("z_seq"))
    zero = F.lit(0).cast("bigint")
    is_http, is_ftp = kind == "http", kind == "ftp"
    paired = taken.unionByName(given).select(
        "merge_seq", "a_seq", "z_seq", "kind", "key", "service",
        F.when(is_http, F.col("trans_depth")).otherwise(zero).alias("trans_depth"),
        F.when(is_http, F.col("response_body_len")).otherwise(zero).alias("response_body_len"),
        zero.alias("ct_flw_http_mthd"), F.when(is_ftp, F.col("is_ftp_login")).otherwise(0).alias("is_ftp_login"),
        F.when(is_ftp, F.col("has_command")).otherwise(0).cast("bigint").alias("ct_ftp_cmd"), *CARRIED)
    merges = paired.unionByName(fold_merges(ranked))
    # http merges are counted, ftp merges add up their commands
    counted = keyed_scan(merges.where(is_http | is_ftp).drop("ct_flw_http_mthd").withColumnRenamed("ct_ftp_cmd", "__cmd"),
                         ["key"], "merge_seq", [Running("__http", is_http.cast("bigint")), Running("__ftp", F.col("__cmd"))], width)
    counted = counted.select("*", F.when(is_http, F.col("__http")).otherwise(zero).alias("ct_flw_http_mthd"),
                             F.when(is_ftp, F.col("__ftp")).otherwise(zero).alias("ct_ftp_cmd"))
    return merges.where(~is_http & ~is_ftp).select(*MERGE_COLUMNS).unionByName(counted.select(*MERGE_COLUMNS))


def replay_merges(flows: DataFrame, logs: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Merges exactly as the live loop produces them, in narrow form."""
    return replay_events(timeline(flows, logs), width)
