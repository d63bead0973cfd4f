"""Arrival-order matching of sensor-A flows with sensor-B log records.

Everything is decided per flow key by arrival order (``seq``, unique over both sensors).
The set form below needs no sequential code: running counts on one timeline give

* the http epoch of a record (flows of the key seen before it),
* the ordinal of a waiting flow and of a conn record (first in, first out pairing),
* for an ftp record the ordinal of the oldest flow still waiting.

The scans split hot keys over blocks, and the joins run on ``(key, ordinal)``, which is
unique on the flow side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import enrich
from flowloom.functions.keys import flow_key, log_key
from flowloom.operators.scan import BLOCK_WIDTH, Running, block_index, keyed_scan, ordinal
from flowloom.session import cut_lineage

MATCHED_PROTOCOLS = ["tcp", "udp", "icmp"]
CARRIED = ["saddr", "sport", "daddr", "dport", "ltime"]


def fifo_match(a: DataFrame, z: DataFrame, key: str = "key", a_order: str = "a_seq", z_order: str = "z_seq",
               width: int = BLOCK_WIDTH, how: str = "inner") -> DataFrame:
    """One-to-one match on ``key``: each arrival pairs with the oldest waiting partner.

    ``how='full'`` keeps the rows left without partner on either side.
    """
    left = ordinal(a, [key], a_order, "__rn", width)
    right = ordinal(z, [key], z_order, "__rn", width)
    return left.join(right, [key, "__rn"], how).drop("__rn")


def lower_proto() -> Column:
    return F.lower(F.coalesce(F.col("proto"), F.lit("")))


def timeline(flows: DataFrame, logs: DataFrame) -> DataFrame:
    """Both sensors as one narrow event list: key, seq, kind and the columns matching needs."""
    proto = lower_proto()
    a = (flows.where(proto.isin(MATCHED_PROTOCOLS))
         .select(flow_key().alias("key"), "seq",
                 F.when(proto == "tcp", F.lit("tcp")).otherwise(F.lit("dgram")).alias("kind"),
                 *CARRIED))
    kind = F.lower(F.col("zeek_log"))
    b = logs.select(
        log_key().alias("key"), "seq", kind.alias("kind"),
        enrich.service_name(kind, F.col("service")).alias("service"),
        F.coalesce(F.col("trans_depth"), F.lit(0)).cast("bigint").alias("trans_depth"),
        F.coalesce(F.col("response_body_len"), F.lit(0)).cast("bigint").alias("response_body_len"),
        enrich.ftp_login(F.col("user_name"), F.col("password")).alias("is_ftp_login"),
        enrich.ftp_command_present(F.col("command")).alias("has_command"))
    return a.unionByName(b, allowMissingColumns=True)


@dataclass(frozen=True)
class Matched:
    """Lazy results of the set form.

    ``merges`` has one row per merged flow in narrow form; the unmatched frames, built when
    asked for, hold ``seq`` values to anti-join or semi-join with the inputs.
    """

    merges: DataFrame
    ranked: DataFrame
    queued: DataFrame
    conns: DataFrame

    @property
    def unmatched_flows(self) -> DataFrame:
        lost = self.queued.join(self.conns, ["key", "rn"], "left_anti")
        return lost.select(F.col("a_seq").alias("seq"))

    @property
    def unmatched_logs(self) -> DataFrame:
        kind = F.col("kind")
        conn = self.conns.join(self.queued, ["key", "rn"], "left_anti").select(F.col("z_seq").alias("seq"))
        ftp = self.ranked.where((kind == "ftp") & ~_has_waiting()).select("seq")
        http = self.ranked.where(kind == "http").join(
            self.ranked.where("folds").select("key", "epoch"), ["key", "epoch"], "left_anti").select("seq")
        return conn.unionByName(ftp).unionByName(http)


def _has_waiting() -> Column:
    return F.col("flows_seen") > F.col("conns_seen")


def ranked_timeline(events: DataFrame, width: int = BLOCK_WIDTH, peaks: bool = False) -> DataFrame:
    """Add to every event what matching decides on, in one exchange of the timeline.

    * ``epoch``: tcp flows of the key seen before,
    * ``folds``: a tcp flow with http rows since the previous tcp flow takes them,
    * ``flows_seen`` / ``conns_seen`` / ``https_seen``: waiting-eligible flows, conn and http
      rows up to here,
    * ``folds_seen``: flows that took http rows up to here,
    * ``peak``, if asked for: largest ``flows_seen - https_seen``, 0 at least, at waiting-eligible flows before.

    The fold flags need one look at the previous block: only the first tcp flow of a block
    with no http row before it is open, and whether http rows are pending there is known
    from the block summaries. Counts after such a flow are shifted accordingly.
    """
    kind = F.col("kind")
    group = ["key", "__blk"]
    work = events.withColumn("__blk", block_index("seq", width)).repartition(*group)
    span = Window.partitionBy(*group).orderBy("seq")
    upto = span.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = span.rowsBetween(Window.unboundedPreceding, -1)

    def counted(condition, frame):
        return F.coalesce(F.sum(condition.cast("bigint")).over(frame), F.lit(0))

    seen = work.select(
        *work.columns, counted(kind == "tcp", before).alias("__epoch"),
        F.max(F.when(kind == "tcp", F.col("seq"))).over(before).alias("__flow"),
        F.max(F.when(kind == "http", F.col("seq"))).over(before).alias("__http"))
    flagged = (seen
               .withColumn("__folds", (kind == "tcp") & F.coalesce(
                   F.col("__http") > F.coalesce("__flow", F.lit(-1 << 62)), F.lit(False)))
               .withColumn("__open", (kind == "tcp") & F.col("__flow").isNull() & F.col("__http").isNull())
               .drop("__flow", "__http"))
    waits = (kind == "dgram") | ((kind == "tcp") & ~F.col("__folds"))
    local = flagged.select(
        *flagged.columns, counted(waits, upto).alias("__waits_to"), counted(F.col("__folds"), upto).alias("__folds_to"),
        counted(F.col("__open"), upto).alias("__open_to"), counted(kind == "conn", upto).alias("__conns_to"),
        counted(kind == "http", upto).alias("__https_to"))
    # the largest lead inside the block, with the open flow waiting and with it folding
    lead = F.col("__waits_to") - F.col("__https_to")
    leads = [F.when(waits, lead), F.when(waits & ~F.col("__open"), lead - F.col("__open_to"))] if peaks else []
    local = local.select(*local.columns, *[F.max(c).over(before).alias(f"__lead{i}") for i, c in enumerate(leads)])

    blocks = local.groupBy(*group).agg(
        F.sum((kind == "tcp").cast("bigint")).alias("tcp"), F.sum(waits.cast("bigint")).alias("waits"),
        F.sum(F.col("__folds").cast("bigint")).alias("folds"), F.max(F.col("__open").cast("bigint")).alias("open"),
        F.sum((kind == "conn").cast("bigint")).alias("conns"), F.sum((kind == "http").cast("bigint")).alias("https"),
        (F.max(F.when(kind == "http", F.col("seq"))) >
         F.coalesce(F.max(F.when(kind == "tcp", F.col("seq"))), F.lit(-1 << 62))).alias("__ends_http"),
        F.max(F.when(kind == "tcp", F.col("seq"))).alias("__last_tcp"),
        *[F.max(c).alias(f"__most{i}") for i, c in enumerate(leads)])
    past = Window.partitionBy("key").orderBy("__blk")
    earlier = past.rowsBetween(Window.unboundedPreceding, -1)
    pending = F.coalesce(F.col("__ends_http"), F.when(F.col("__last_tcp").isNotNull(), F.lit(False)))
    shifted = blocks.select(
        *blocks.columns, F.lag("__blk").over(past).alias("__prev"),
        (F.col("open") * F.coalesce(F.last(pending, ignorenulls=True).over(earlier), F.lit(False)).cast("bigint"))
        .alias("__shift"))
    carry = shifted.select(
        "key", "__blk", "__prev", "__shift", *[f"__most{i}" for i in range(len(leads))],
        F.sum("tcp").over(earlier).alias("__c_epoch"),
        F.sum(F.col("waits") - F.col("__shift")).over(earlier).alias("__c_waits"),
        F.sum(F.col("folds") + F.col("__shift")).over(earlier).alias("__c_folds"),
        F.sum("conns").over(earlier).alias("__c_conns"),
        F.sum("https").over(earlier).alias("__c_https"))

    def carried(name):
        return F.coalesce(F.col(name), F.lit(0))

    ahead, peak = carried("__c_waits") - carried("__c_https"), []
    if peaks:
        most = F.when(F.col("__shift") == 1, F.col("__most1")).otherwise(F.col("__most0"))
        carry = carry.select(*carry.columns, F.max(ahead + most).over(earlier).alias("__c_peak")).drop("__most0", "__most1")
        inside = F.when(carried("__shift") == 1, F.col("__lead1")).otherwise(F.col("__lead0"))
        peak = [F.greatest(F.lit(0).cast("bigint"), F.col("__c_peak"), ahead + inside).alias("peak")]
    carry = carry.where(F.col("__prev").isNotNull()).drop("__prev")
    shift = F.col("__open_to") * carried("__shift")
    return local.join(carry, group, "left").select(
        *events.columns,
        (F.col("__epoch") + carried("__c_epoch")).alias("epoch"),
        (F.col("__folds") | (F.col("__open") & (carried("__shift") == 1))).alias("folds"),
        (F.col("__waits_to") + carried("__c_waits") - shift).alias("flows_seen"),
        (F.col("__folds_to") + carried("__c_folds") + shift).alias("folds_seen"),
        (F.col("__conns_to") + carried("__c_conns")).alias("conns_seen"),
        (F.col("__https_to") + carried("__c_https")).alias("https_seen"), *peak)


def http_fold(ranked: DataFrame) -> DataFrame:
    """Sum of lengths and largest depth of the http rows per (key, epoch)."""
    return (ranked.where(F.col("kind") == "http").groupBy("key", "epoch")
            .agg(F.sum("response_body_len").alias("response_body_len"),
                 F.greatest(F.max("trans_depth"), F.lit(0)).alias("trans_depth"),
                 F.max("seq").alias("z_seq")))


def fold_merges(ranked: DataFrame) -> DataFrame:
    """One merge per tcp flow that takes the http rows of its epoch."""
    folded = ranked.where(F.col("folds")).select(
        "key", "epoch", F.col("seq").alias("a_seq"), F.col("folds_seen").alias("ct_flw_http_mthd"), *CARRIED)
    return folded.join(http_fold(ranked), ["key", "epoch"]).select(
        F.col("a_seq").alias("merge_seq"), "a_seq", "z_seq", F.lit("http").alias("kind"), "key",
        F.lit("http").alias("service"), "trans_depth", "response_body_len", "ct_flw_http_mthd",
        F.lit(0).alias("is_ftp_login"), F.lit(0).cast("bigint").alias("ct_ftp_cmd"), *CARRIED)


def match_sensors(flows: DataFrame, logs: DataFrame, width: int = BLOCK_WIDTH) -> Matched:
    """Set form of the two-sensor merge: http fold, first in first out conn match, ftp fan-out."""
    kind = F.col("kind")
    # narrow, and read by every branch below
    ranked = cut_lineage(ranked_timeline(timeline(flows, logs), width))
    queued = ranked.where(kind.isin("tcp", "dgram") & ~F.col("folds")).select(
        "key", F.col("flows_seen").alias("rn"), F.col("seq").alias("a_seq"), *CARRIED)
    zero = F.lit(0).cast("bigint")
    conns = ranked.where(kind == "conn").select(
        "key", F.col("conns_seen").alias("rn"), F.col("seq").alias("z_seq"), "kind", "service",
        F.lit(0).alias("is_ftp_login"), zero.alias("ct_ftp_cmd"))
    # the oldest flow still waiting follows those the conn rows have taken
    ftp = keyed_scan(
        ranked.where((kind == "ftp") & _has_waiting()).select(
            "key", (F.col("conns_seen") + 1).alias("rn"), F.col("seq").alias("z_seq"), "kind", "service",
            "is_ftp_login", "has_command"),
        ["key"], "z_seq", [Running("ct_ftp_cmd", F.col("has_command").cast("bigint"))], width).drop("has_command")

    paired = queued.join(conns.unionByName(ftp), ["key", "rn"]).select(
        F.when(kind == "ftp", F.col("z_seq")).otherwise(F.greatest("a_seq", "z_seq")).alias("merge_seq"),
        "a_seq", "z_seq", "kind", "key", "service", zero.alias("trans_depth"),
        zero.alias("response_body_len"), zero.alias("ct_flw_http_mthd"), "is_ftp_login", "ct_ftp_cmd", *CARRIED)

    http = fold_merges(ranked)
    return Matched(paired.unionByName(http), ranked, queued, conns)


def pass_through(flows: DataFrame) -> DataFrame:
    """Flows of other protocols: merged without partner and without service."""
    zero = F.lit(0).cast("bigint")
    return flows.where(~lower_proto().isin(MATCHED_PROTOCOLS)).select(
        F.col("seq").alias("merge_seq"), F.col("seq").alias("a_seq"),
        F.lit(None).cast("bigint").alias("z_seq"), F.lit("other").alias("kind"),
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("service"),
        zero.alias("trans_depth"), zero.alias("response_body_len"), zero.alias("ct_flw_http_mthd"),
        F.lit(0).alias("is_ftp_login"), zero.alias("ct_ftp_cmd"), *CARRIED)
