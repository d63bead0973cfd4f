"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.catalog import fixtures
from flowloom.catalog.fixtures import flows, logs
from flowloom.functions import address, coerce, enrich
from flowloom.functions.keys import flow_key, has_four_tuple, log_key
from flowloom.operators import (
    categories, dataset, enrichment, evaluation, history, matching, netranges, profile, replay, scan,
    timematch)
from flowloom.plans import merge, scoring, training
from flowloom.schemas import HTTP_PROFILE_FIELDS, NUMERIC_FIELDS, PROTO_LABELS, SCORING_FIELDS, STATE_LABELS
from flowloom.sources import flows as sources_flows
from flowloom.sources.arrival import line_session, placed_lines
from flowloom.streaming import match as stream_match
from flowloom.streaming.history import HistoryBatches
from flowloom.streaming.sinks import MergeSinks, RawSink, ScoreSinks
from flowloom.streaming.sources import parse_scoring
from flowloom.session import SETTINGS, checkpoint_root, cut_lineage
from flowloom.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- merge --------------------------------------------------------------------

@query
def merged_flows(spark, sf):
    return merge.merge_flows(flows(spark, sf), logs(spark, sf))


@query
def scoring_csv(spark, sf):
    merged = merged_flows(spark, sf).withColumn("stime", coerce.half_even_seconds(F.col("stime")))
    return merge.scoring_lines(merged)


def _keyed(spark, sf):
    a = (flows(spark, sf).where(matching.lower_proto().isin(matching.MATCHED_PROTOCOLS))
         .withColumn("key", flow_key()))
    z = logs(spark, sf).withColumn("key", log_key())
    return a, z


def _merges(spark, sf, kind):
    found = matching.match_sensors(flows(spark, sf), logs(spark, sf)).merges
    return found.where(F.col("kind") == kind)


@query
def fifo_match(spark, sf):
    return _merges(spark, sf, "conn").select("key", "a_seq", "z_seq", "merge_seq", "service")


@query
def icmp_match(spark, sf):
    a, z = _keyed(spark, sf)
    return matching.fifo_match(
        a.where("proto = 'icmp'").select("key", F.col("seq").alias("a_seq")),
        z.where("proto = 'icmp' and zeek_log = 'conn'").select("key", F.col("seq").alias("z_seq")))


@query
def http_fold_join(spark, sf):
    return _merges(spark, sf, "http").select(
        "key", "a_seq", "z_seq", "trans_depth", "response_body_len", "ct_flw_http_mthd")


@query
def ftp_fanout(spark, sf):
    return _merges(spark, sf, "ftp").select("key", "a_seq", "z_seq", "is_ftp_login", "ct_ftp_cmd")


@query
def other_passthrough(spark, sf):
    a = flows(spark, sf)
    rows = merge.attach_measurements(a, matching.pass_through(a))
    return rows.select("merge_seq", "proto", "saddr", "daddr", "service", "is_sm_ips_ports")


@query
def protocol_routes(spark, sf):
    a = flows(spark, sf)
    rows = matching.match_sensors(a, logs(spark, sf)).merges.unionByName(matching.pass_through(a))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("merges"), F.countDistinct("a_seq").alias("flows"),
                                    F.count("service").alias("with_service"))


@query
def unmatched_a(spark, sf):
    a = flows(spark, sf)
    return a.join(matching.match_sensors(a, logs(spark, sf)).unmatched_flows, "seq", "left_semi")


@query
def unmatched_b(spark, sf):
    z = logs(spark, sf)
    return z.join(matching.match_sensors(flows(spark, sf), z).unmatched_logs, "seq", "left_semi")


def _sequence(spark, sf, same_second=True):
    a = flows(spark, sf)
    found = matching.match_sensors(a, logs(spark, sf)).merges
    return merge.merged_sequence(a, found, same_second)


def _counter(name):
    def run(spark, sf):
        return _sequence(spark, sf).select("merge_seq", "n", name)
    run.__name__ = name
    return run


for _name in history.COUNTERS:
    query(_counter(_name))


@query
def counters_any_second(spark, sf):
    return _sequence(spark, sf, same_second=False).select("merge_seq", *history.COUNTERS)


@query
def merge_sequence(spark, sf):
    a = flows(spark, sf)
    rows = matching.match_sensors(a, logs(spark, sf)).merges.unionByName(matching.pass_through(a))
    return scan.dense_sequence(rows.select("merge_seq", "a_seq"), "merge_seq", "n")


@query
def http_epochs(spark, sf):
    events = matching.timeline(flows(spark, sf), logs(spark, sf))
    return matching.ranked_timeline(events).where("kind = 'http'").select("key", "seq", "epoch")


@query
def pairing_ordinal(spark, sf):
    a, _ = _keyed(spark, sf)
    return scan.ordinal(a.select("key", "seq"), ["key"], "seq", "rn")


# --- projections, filters and scalar functions --------------------------------

@query
def header_drop(spark, sf):
    """Text rows, some without a readable time, plus a header row, which alone is dropped."""
    time = F.when(F.col("dpkts") == 0, F.lit("n/a")).otherwise(F.col("stime_us").cast("string"))
    texts = flows(spark, sf).withColumn("stime_us", time).select(
        *[F.col(c).cast("string").alias(c) for c in ("seq", "stime_us", "proto", "sport")])
    header = texts.agg(*[F.coalesce(F.max(F.lit(c)), F.lit(c)).alias(c) for c in texts.columns])
    return sources_flows.without_header(texts.unionByName(header))


@query
def ordered_projection(spark, sf):
    named = flows(spark, sf).withColumnsRenamed({"saddr": "srcip", "daddr": "dstip", "dport": "dsport"})
    keep = ["label", "dsport", "srcip", "proto", "sjit", "dur", "no_such_column", "attack_cat"]
    return dataset.ordered_projection(named, keep)


@query
def fixed_layout(spark, sf):
    return merge.fixed_layout(flows(spark, sf).select("seq", "proto", "dur"), ["seq", "service", "proto", "dur"])


def _raw_labels(spark, sf):
    """Labels as text, some of them unusable."""
    text = F.when(F.col("dpkts") == 0, F.lit("n/a")).when(F.col("dpkts") == 1, F.lit("2")) \
        .when(F.col("dpkts") == 2, F.lit(None)).otherwise(F.col("label").cast("string"))
    return flows(spark, sf).select("seq", text.alias("label"))


@query
def label_filter(spark, sf):
    return dataset.valid_labels(_raw_labels(spark, sf))


@query
def numeric_coercion(spark, sf):
    mixed = flows(spark, sf).select("seq", F.col("label").cast("string").alias("raw"),
                                    F.coalesce("attack_cat", F.col("dur").cast("string")).alias("value"))
    return coerce.coerce_numeric(mixed, ["value", "absent"])


@query
def epoch_conversion(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    text = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("string"))
    return orders.select("o_orderkey", coerce.epoch_seconds(text).alias("epoch"))


@query
def port_cast(spark, sf):
    number = F.col("dport")
    text = (F.when(F.col("state") == "FIN", F.concat(F.lit("0x"), F.hex(number)))
            .when(F.col("state") == "CON", F.concat(F.lit(" "), number.cast("string"), F.lit(" ")))
            .when(F.col("state") == "INT", F.concat(number.cast("string"), F.lit(".0")))
            .when(F.col("state") == "REQ", F.lit("")).otherwise(number.cast("string")))
    return flows(spark, sf).select("seq", coerce.port_number(text).alias("port"))


@query
def half_even_seconds(spark, sf):
    return flows(spark, sf).select("seq", coerce.half_even_seconds(F.col("stime")).alias("stime"),
                                   coerce.half_even_seconds(F.col("sbytes") / 2).alias("half_bytes"))


@query
def flow_keys_a(spark, sf):
    return flows(spark, sf).select("seq", flow_key().alias("key"))


@query
def flow_keys_b(spark, sf):
    return logs(spark, sf).select("seq", log_key().alias("key"))


@query
def same_endpoint(spark, sf):
    return flows(spark, sf).select("seq", enrich.same_endpoint().alias("is_sm_ips_ports"))


@query
def ftp_login_flag(spark, sf):
    return logs(spark, sf).where("zeek_log = 'ftp'").select(
        "seq", enrich.ftp_login(F.col("user_name"), F.col("password")).alias("is_ftp_login"),
        enrich.ftp_command_present(F.col("command")).alias("has_command"))


@query
def service_default(spark, sf):
    return logs(spark, sf).select("seq", enrich.service_name(F.col("zeek_log"), F.col("service")).alias("service"))


@query
def class_names(spark, sf):
    return flows(spark, sf).groupBy(coerce.class_name(F.col("label")).alias("attack_type")).agg(
        F.count(F.lit(1)).alias("flows"))


@query
def cast_and_fill(spark, sf):
    cols = ["sjit", "djit", "sintpkt", "dintpkt", "spkts", "absent"]
    return coerce.cast_and_fill(flows(spark, sf).select("seq", *cols[:-1]), cols)


@query
def scoring_float(spark, sf):
    text = F.coalesce("attack_cat", F.col("dpkts").cast("string"))
    return flows(spark, sf).select("seq", coerce.scoring_float(text).alias("value"))


@query
def category_lookup(spark, sf):
    states = F.when(F.col("dpkts") == 0, F.lit("XXX")).otherwise(F.col("state"))
    named = flows(spark, sf).select("seq", "proto", states.alias("state"))
    indexed = categories.apply_category_index(named, "proto", categories.index_frame(spark, PROTO_LABELS))
    return categories.apply_category_index(indexed, "state", categories.index_frame(spark, STATE_LABELS))


@query
def event_latency(spark, sf):
    now = F.lit(1_800_000_000.0)
    text = F.when(F.col("state") == "REQ", F.lit("n/a")).otherwise(F.floor("stime").cast("string"))
    return flows(spark, sf).select("seq", enrich.latency_seconds(text, now).alias("latency"))


@query
def flow_text(spark, sf):
    return flows(spark, sf).select("seq", enrich.flow_text().alias("flow"))


@query
def ipv4_numbers(spark, sf):
    raw = F.when(F.col("state") == "REQ", F.lit("fe80::1")).when(F.col("state") == "CON", F.concat("daddr", F.lit(".300"))) \
        .otherwise(F.col("saddr"))
    return flows(spark, sf).select("seq", address.ipv4_number(raw).alias("number"))


@query
def capture_filter(spark, sf):
    proto = F.when(F.col("proto") == "arp", F.lit("man")).otherwise(F.col("proto"))
    return sources_flows.captured(flows(spark, sf).withColumn("proto", proto)).select("seq", "proto")


@query
def four_tuple_filter(spark, sf):
    port = F.when(F.col("resp_p") == 21, F.lit(0)).otherwise(F.col("resp_p"))
    holes = logs(spark, sf).withColumn("resp_p", port).withColumn(
        "orig_h", F.when(F.col("trans_depth") == 0, F.lit("")).otherwise(F.col("orig_h")))
    return holes.where(has_four_tuple("orig_h", "orig_p", "resp_h", "resp_p")).select("seq", "orig_h", "resp_p")


@query
def upper_method(spark, sf):
    return logs(spark, sf).groupBy(F.upper("method").alias("method"), F.upper("command").alias("command")).agg(
        F.count(F.lit(1)).alias("records"))


@query
def time_guard(spark, sf):
    holes = flows(spark, sf).withColumn("stime_us", F.when(F.col("dpkts") > 0, F.col("stime_us")))
    return sources_flows.timed(holes, "stime_us").select("seq", "stime_us")


# --- time matching and reconciliation ------------------------------------------

def _times(spark, sf):
    return (flows(spark, sf).select(F.col("seq").alias("a_seq"), F.col("stime_us").alias("a_us")),
            logs(spark, sf).select(F.col("seq").alias("z_seq"), F.col("ts_us").alias("z_us")))


@query
def exact_time_match(spark, sf):
    return timematch.nearest_time_match(*_times(spark, sf), 0)


@query
def nearest_time_match(spark, sf):
    return timematch.nearest_time_match(*_times(spark, sf), 1000)


@query
def inexact_matches(spark, sf):
    return timematch.inexact_matches(nearest_time_match(spark, sf))


@query
def interval_match(spark, sf):
    a, z = _keyed(spark, sf)
    return timematch.interval_match(
        a.select("key", F.col("seq").alias("a_seq"), F.col("stime_us").alias("a_us")),
        z.select("key", F.col("seq").alias("z_seq"), F.col("ts_us").alias("z_us")), 1000)


# Ten minutes: windows of several flows and logs, so that rows compete.
WIDE = 600_000_000


def _late(z):
    """Every fiftieth record arrives behind the hundred events that follow it."""
    return z.withColumn("z_seq", F.col("z_seq") + F.when(F.round(F.col("z_seq") / 4) % 50 == 0, 401).otherwise(0))


@query
def nearest_in_ten_minutes(spark, sf):
    return timematch.nearest_time_match(*_times(spark, sf), WIDE, block=512)


@query
def nearest_late_records(spark, sf):
    a, z = _times(spark, sf)
    return timematch.nearest_time_match(a, _late(z), WIDE, block=512)


@query
def interval_of_hot_keys(spark, sf):
    """Keys are protocols, of which one holds most rows; some records are late."""
    z = _late(logs(spark, sf).select("proto", F.col("seq").alias("z_seq"), F.col("ts_us").alias("z_us")))
    a = flows(spark, sf).select("proto", F.col("seq").alias("a_seq"), F.col("stime_us").alias("a_us"))
    return timematch.interval_match(a, z, WIDE, key="proto", block=512)


@query
def band_semi(spark, sf):
    a, z = _times(spark, sf)
    return timematch.band_semi(a, z, 500)


@query
def band_anti(spark, sf):
    a, z = _times(spark, sf)
    return timematch.band_anti(a, z, 500)


@query
def match_summary(spark, sf):
    a, _ = _times(spark, sf)
    # records without a method stand for those without a readable time
    z = logs(spark, sf).select(F.col("seq").alias("z_seq"), F.when(F.col("method").isNotNull(), F.col("ts_us")).alias("z_us"))
    pairs = timematch.nearest_time_match(a, z.where("z_us is not null"), 0)
    return timematch.match_summary(a, z, pairs)


@query
def unmatched_by_time(spark, sf):
    a, z = _times(spark, sf)
    return timematch.unmatched(a, timematch.nearest_time_match(a, z, 0), "a_seq")


@query
def time_islands(spark, sf):
    a, _ = _times(spark, sf)
    return scan.time_islands(a, "a_us", 120_000_000)


@query
def time_sort(spark, sf):
    a = flows(spark, sf).withColumn("second", F.floor("stime").cast("bigint"))
    return scan.sorted_scan(a.select("second", "seq"), [], ["second", "seq"],
                            [scan.Running("position", F.lit(1).cast("bigint"))])


@query
def conn_enrich(spark, sf):
    return enrichment.conn_enrich(logs(spark, sf), ttl=20 * 86_400_000_000).select(
        "seq", "service", "trans_depth", "response_body_len", "method", "user_name", "password", "command")


@query
def http_last100(spark, sf):
    z = logs(spark, sf)
    keys = [F.col("orig_h"), F.col("orig_p"), F.col("resp_h"), F.col("resp_p"), F.upper("method")]
    return history.last_n_count(z, "seq", keys, "ct_flw_http_mthd",
                                (F.col("zeek_log") == "http") & F.col("method").isNotNull()) \
        .select("seq", "ct_flw_http_mthd")


@query
def ftp_last100(spark, sf):
    z = logs(spark, sf)
    keys = [F.col("orig_h"), F.col("orig_p"), F.col("resp_h"), F.col("resp_p"), F.upper("command")]
    return history.last_n_count(z, "seq", keys, "ct_ftp_cmd",
                                (F.col("zeek_log") == "ftp") & (F.col("command") != "")).select("seq", "ct_ftp_cmd")


# --- allow-list, verdicts, alerts ----------------------------------------------

RANGES = [("gcloud", "10.0.0.0/28"), ("aws", "10.0.0.8/29"), ("canonical", "10.0.1.4/31"), ("suse", "10.0.0.48/30")]


def _reasoned(spark, sf):
    ranges = spark.createDataFrame(RANGES, "provider string, cidr string")
    metadata = F.when(F.col("dport") == 1024, F.lit(address.METADATA_ADDRESS)).otherwise(F.col("daddr"))
    return netranges.allow_reason(flows(spark, sf).withColumn("daddr", metadata), ranges)


@query
def allow_list(spark, sf):
    return _reasoned(spark, sf).select("seq", "saddr", "daddr", "reason")


def _address(number: str):
    """Dotted text of an address in 10.0.0.0/8."""
    return F.expr(f"concat_ws('.', '10', cast({number} div 65536 % 256 as string), cast({number} div 256 % 256 as string), "
                  f"cast({number} % 256 as string))")


@query
def allow_list_dense(spark, sf):
    """One range per order, nested and touching, looked up by the addresses of all line items."""
    networks = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey * 7919 % 16777216 as number", "20 + o_custkey % 13 as length", "o_custkey % 5 as place")
    names = F.array(*[F.lit(name) for name, _ in netranges.PROVIDERS])
    ranges = networks.select(F.get(names, F.col("place").cast("int")).alias("provider"),
                             F.concat(_address("number"), F.lit("/"), F.col("length").cast("string")).alias("cidr"))
    probes = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_linenumber", "(l_orderkey * 7919 + l_linenumber * 37) % 16777216 as s",
        "(l_partkey * 104729 + l_linenumber) % 16777216 as d")
    shown = probes.select("l_orderkey", "l_linenumber", _address("s").alias("saddr"), _address("d").alias("daddr"))
    return netranges.allow_reason(shown, ranges)


def _scored(spark, sf):
    return _reasoned(spark, sf).withColumn("probability", (F.col("sbytes") % 100) / F.lit(100.0))


@query
def verdicts(spark, sf):
    p, r = F.col("probability"), F.col("reason")
    return _scored(spark, sf).select("seq", enrich.verdict(p, r).alias("verdict"), enrich.severity(p, r).alias("severity"))


@query
def alert_lines(spark, sf):
    return sinks.alert_lines(_scored(spark, sf))


# --- profiling ------------------------------------------------------------------

PROFILED = ["proto", "state", "label", "attack_cat"]


@query
def value_counts(spark, sf):
    return profile.ranked_counts(flows(spark, sf), PROFILED)


@query
def attack_category_counts(spark, sf):
    return profile.value_counts(flows(spark, sf).where("label = 1"), ["attack_cat"])


@query
def label_share(spark, sf):
    return profile.label_shares(flows(spark, sf))


@query
def presence(spark, sf):
    return profile.has_value(flows(spark, sf), "label", 1)


def _rounded(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def describe_numeric(spark, sf):
    return _rounded(profile.describe(flows(spark, sf), NUMERIC_FIELDS))


@query
def describe_lineitem(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return _rounded(profile.describe(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query
def describe_approximate(spark, sf):
    return _rounded(profile.describe(flows(spark, sf), NUMERIC_FIELDS, approx=True))


@query
def sentinel_profile(spark, sf):
    return _rounded(profile.sentinel_profile(flows(spark, sf), NUMERIC_FIELDS))


@query
def full_profile(spark, sf):
    return _rounded(profile.full_profile(flows(spark, sf), ["sjit", "djit", "sintpkt", "dintpkt"]))


@query
def short_flow_stats(spark, sf):
    return _rounded(profile.short_flow_stats(flows(spark, sf)))


@query
def http_profile(spark, sf):
    return _rounded(profile.full_profile(merged_flows(spark, sf), HTTP_PROFILE_FIELDS))


# --- dataset preparation ----------------------------------------------------------

@query
def csv_union(spark, sf):
    a = flows(spark, sf).select("seq", "proto", "saddr", "dur", "label")
    parts = [a.where("proto = 'tcp'"), a.where("proto = 'udp'").withColumnRenamed("dur", "duration"),
             a.where("proto not in ('tcp', 'udp')")]
    return dataset.positional_union(parts)


@query
def log_union(spark, sf):
    z = logs(spark, sf)
    return sources_flows.union_logs({
        "conn": z.where("zeek_log = 'conn'").select("seq", "service"),
        "http": z.where("zeek_log = 'http'").select("seq", "method", "trans_depth"),
        "ftp": z.where("zeek_log = 'ftp'").select("seq", "command")})


@query
def balanced_sample(spark, sf):
    return dataset.balance(flows(spark, sf), ratio=3).select("seq", "label", "dur", "attack_cat")


@query
def seeded_shuffle(spark, sf):
    ranked = dataset.class_rank(flows(spark, sf).select("seq", F.lit(0).alias("all")), "all", "seq", name="position")
    return ranked.select("seq", "position")


@query
def hash_split(spark, sf):
    return dataset.hash_split(flows(spark, sf).select("seq", "label"), "seq")


@query
def stratified_folds(spark, sf):
    return dataset.stratified_folds(flows(spark, sf).select("seq", "label"), "label", "seq")


@query
def category_index(spark, sf):
    return categories.fit_category_index(flows(spark, sf), "state")


# --- evaluation --------------------------------------------------------------------

def _predicted(spark, sf):
    return flows(spark, sf).select("seq", "label", (F.col("dur") > 40).cast("int").alias("prediction"))


@query
def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(_predicted(spark, sf))


@query
def classification_report(spark, sf):
    return _rounded(evaluation.classification_report(confusion_matrix(spark, sf)), 6)


@query
def accuracy(spark, sf):
    return _rounded(evaluation.accuracy(_predicted(spark, sf)), 6)


@query
def fold_accuracy(spark, sf):
    """Mean accuracy over folds of two decision thresholds, best one reported."""
    folded = dataset.stratified_folds(flows(spark, sf).select("seq", "label", "dur"), "label", "seq")
    tried = folded.select("label", "fold", "dur", F.explode(F.array(F.lit(40), F.lit(80))).alias("threshold"))
    results = tried.groupBy("threshold", "fold").agg(
        F.avg((F.col("label") == (F.col("dur") > F.col("threshold")).cast("int")).cast("double")).alias("accuracy"))
    return _rounded(evaluation.best_params(evaluation.mean_accuracy(results, ["threshold"]), ["threshold"]), 6)


# --- record-by-record replay ---------------------------------------------------------

@query
def replay_merges(spark, sf):
    return replay.replay_merges(flows(spark, sf), logs(spark, sf)).select(
        "merge_seq", "a_seq", "z_seq", "kind", "service", "trans_depth", "response_body_len",
        "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd")


def _one_hot_key(df, source: str, source_port: str, target: str, target_port: str):
    """Every third event on one key of tcp traffic."""
    third = F.round(F.col("seq") / 4) % 3 == 0
    fixed = {"proto": "tcp", source: "10.9.9.9", source_port: 1024, target: "10.9.9.8", target_port: 21}
    return df.withColumns({c: F.when(third, F.lit(v)).otherwise(F.col(c)) for c, v in fixed.items()})


@query
def replay_hot_ftp(spark, sf):
    """A third of both sensors on one key that has ftp records."""
    return replay.replay_merges(_one_hot_key(flows(spark, sf), "saddr", "sport", "daddr", "dport"),
                                _one_hot_key(logs(spark, sf), "orig_h", "orig_p", "resp_h", "resp_p")).select(
        "merge_seq", "a_seq", "z_seq", "kind", "service", "trans_depth", "response_body_len",
        "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd")


@query
def replay_flows(spark, sf):
    return merge.merge_flows(flows(spark, sf), logs(spark, sf), mode="replay")


# --- model --------------------------------------------------------------------------

SMALL_FOREST = {"numTrees": 10, "maxDepth": 5, "featureSubsetStrategy": "sqrt", "minInstancesPerNode": 9}


def _labelled(spark, sf):
    """Merged flows with the label of their flow."""
    labels = flows(spark, sf).select(F.col("stcpb"), F.col("label"), F.col("seq"))
    # fitting reads it several times
    return cut_lineage(merged_flows(spark, sf).join(labels, "stcpb"))


def _fitted(rows):
    train, test = training.split(training.with_target(training.feature_columns(rows)), "merge_seq")
    return training.pipeline(training.forest(SMALL_FOREST)).fit(train), test


@query
def rf_scores(spark, sf):
    """Forest fitted on 80 % of the merged flows, attack probability of the rest."""
    model, test = _fitted(_labelled(spark, sf))
    scored = training.attack_probability(model.transform(test))
    return scored.select("merge_seq", "target", "probability", "prediction")


@query
def rf_report(spark, sf):
    model, test = _fitted(_labelled(spark, sf))
    return training.evaluate(model, test)["report"]


@query
def rf_verdicts(spark, sf):
    rows = _labelled(spark, sf)
    model, _ = _fitted(rows)
    ranges = spark.createDataFrame(RANGES, "provider string, cidr string")
    return scoring.score(rows, model, ranges, now=F.lit(1_800_000_000.0)).select(
        "merge_seq", "probability", "reason", "verdict", "severity", "flow")


# --- streams ------------------------------------------------------------------------

# Micro-batches that the events arrive in, and files of each.
BATCHES, BATCH_FILES = 3, 4


def _land_part(spark, sf, root: str, part: int) -> None:
    """Write one of the parts, of ascending events, that the events table arrives in."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    after = events.agg(F.coalesce(F.max("event_id"), F.lit(0)) + 1).first()[0]
    inside = F.floor(F.col("event_id") * BATCHES / after) == part
    events.where(inside).repartition(BATCH_FILES).write.mode("append").parquet(root)


def _event_streams(spark, sf, landed: str | None = None):
    """The events table as two streams, one per sensor, in several micro-batches of ascending events."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    root = landed or f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    for part in range(0 if landed else BATCHES):
        _land_part(spark, sf, root, part)

    def read():
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(root)
    return fixtures.derive(read(), fixtures.FLOWS), fixtures.derive(read(), fixtures.LOGS)


def _drained(spark, stream, root: str | None = None):
    """Run a stream over everything available, going on where one of the same folder stopped, and read what it wrote."""
    root = root or f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    (stream.writeStream.format("parquet").option("path", f"{root}/out")
     .option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/out")


@query
def stream_merge(spark, sf):
    """The stateful stream yields the replay's merges."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    a, z = _event_streams(spark, sf)
    return _drained(spark, stream_match.stream_merge(a, z)).select(
        "merge_seq", "a_seq", "z_seq", "kind", "service", "trans_depth", "response_body_len",
        "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd")


# Rows wait a day at most; the watermark follows an hour behind.
TTL_MS, DELAY = 86_400_000, "1 hour"


@query
def stream_expired(spark, sf):
    """Merged and lost rows with expiry by event time; the stream is stopped and started again between the parts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    root = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    for part in range(BATCHES):
        _land_part(spark, sf, f"{root}/in", part)
        out = _drained(spark, stream_match.stream_match(*_event_streams(spark, sf, f"{root}/in"), TTL_MS, DELAY), root)
    return out.select("status", "merge_seq", "a_seq", "z_seq", "kind", "ct_flw_http_mthd", "ct_ftp_cmd")


def _run_batches(stream, sink, checkpoint: str) -> None:
    (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


@query
def stream_sinks(spark, sf):
    """What the sinks of a run hold after a merge with a time to live that was stopped and started again between the parts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    root = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    out, schema = f"{root}/out", flows(spark, sf).schema
    for part in range(BATCHES):
        _land_part(spark, sf, f"{root}/in", part)
        a, z = _event_streams(spark, sf, f"{root}/in")
        _run_batches(stream_match.stream_merge(a, z, TTL_MS, DELAY), MergeSinks(out, "r1", schema), f"{root}/merge")
        _run_batches(a, RawSink(out, "r1", "flows"), f"{root}/raw-flows")
        _run_batches(z, RawSink(out, "r1", "logs"), f"{root}/raw-logs")

    counts = ["ct_flw_http_mthd", "ct_ftp_cmd", "ct_srv_src", "ct_dst_src_ltm"]
    read = [("merged", "merge_seq", "stcpb", "service"), ("unmatched/flows", "seq", "stcpb", None),
            ("unmatched/logs", "z_seq", None, "kind"), ("raw/flows", "seq", "stcpb", None), ("raw/logs", "seq", None, "zeek_log")]
    names = [("seq", "bigint"), ("stcpb", "bigint"), ("service", "string"), *[(c, "bigint") for c in counts]]
    lines = parse_scoring(spark.read.text(f"{out}/scoring").withColumnRenamed("value", "line"))
    rows = lines.select(F.lit("scoring").alias("sink"), F.lit(None).cast("bigint").alias("seq"), F.col("stcpb").cast("bigint"),
                        F.lit(None).cast("string").alias("service"), *[F.col(c).cast("bigint") for c in counts])
    for sink, *taken in read:
        taken += counts if sink == "merged" else [None] * len(counts)
        schema = ", ".join(f"{c} {kind}" for c, (_, kind) in zip(taken, names) if c)
        found = spark.read.schema(schema).json(f"{out}/{sink}")
        rows = rows.unionByName(found.select(F.lit(sink).alias("sink"), *[
            (F.col(c) if c else F.lit(None)).cast(kind).alias(name) for c, (name, kind) in zip(taken, names)]))
    return rows


@query
def stream_scores(spark, sf):
    """A forest that was saved and loaded scores lines on a stream stopped and started between two waves of files;
    each line's verdict is held against that of the batch. Every fiftieth line lacks its last field."""
    root = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    metadata = F.when(F.col("dport") == 1024, F.lit(address.METADATA_ADDRESS)).otherwise(F.col("daddr"))
    rows = flows(spark, sf).withColumn("daddr", metadata)
    fitted = training.pipeline(training.forest(SMALL_FOREST)).fit(cut_lineage(training.with_target(training.feature_columns(rows))))
    training.save_bundle(fitted, f"{root}/bundle")
    model, _ = training.load_bundle(spark, f"{root}/bundle")
    ranges, now = spark.createDataFrame(RANGES, "provider string, cidr string"), F.lit(1_800_000_000.0)

    def scored(text):
        return scoring.score_lines(placed_lines(text).withColumnRenamed("value", "line"), model, ranges, now)
    line = enrich.csv_line(SCORING_FIELDS, rows.columns)
    number = F.round(F.col("seq") / 4)
    cut = F.when(number % 50 == 7, F.substring_index(line, ",", len(SCORING_FIELDS) - 1)).otherwise(line)
    reading = line_session(spark)
    for wave in range(2):
        rows.where(number % 2 == wave).select(cut.alias("line")).repartition(BATCH_FILES).write.mode("append").text(f"{root}/in")
        stream = scored(reading.readStream.option("maxFilesPerTrigger", BATCH_FILES // 2).text(f"{root}/in"))
        _run_batches(stream, ScoreSinks(f"{root}/out", "r1"), f"{root}/checkpoint")
    judged = ["probability", "reason", "verdict", "severity", "flow", "latency"]
    verdicts = spark.read.parquet(f"{root}/out/verdicts").select("seq", F.lit(False).alias("malformed"), *judged)
    malformed = spark.read.schema("seq string").json(f"{root}/out/malformed").select("seq", F.lit(True).alias("malformed"))
    streamed = verdicts.unionByName(malformed, allowMissingColumns=True)
    batch = scored(reading.read.text(f"{root}/in"))
    same = F.lit(True)
    for c in ("malformed", *judged):
        same = same & batch[c].eqNullSafe(streamed[c])
    field = F.get(F.split(batch["line"], ","), F.lit(SCORING_FIELDS.index("stcpb"))).cast("bigint")
    return batch.join(streamed, batch["seq"] == streamed["seq"], "full").select(
        field.alias("stcpb"), streamed["malformed"], streamed["reason"], same.alias("same"))


@query
def stream_counters(spark, sf):
    """Counters continued from batch to batch over the merged stream."""
    schema = flows(spark, sf).schema
    root = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    sink = HistoryBatches(root)
    a, z = _event_streams(spark, sf)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    merged = stream_match.unpack(stream_match.stream_merge(a, z), schema)
    (merged.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return sink.read(spark).select("merge_seq", "n", *history.COUNTERS)


@query
def stream_alerts(spark, sf):
    """Stateless scoring stream down to alert lines, probability from the flow itself."""
    a, _ = _event_streams(spark, sf)
    ranges = spark.createDataFrame(RANGES, "provider string, cidr string")
    metadata = F.when(F.col("dport") == 1024, F.lit(address.METADATA_ADDRESS)).otherwise(F.col("daddr"))
    scored = netranges.allow_reason(a.withColumn("daddr", metadata), ranges).withColumn(
        "probability", (F.col("sbytes") % 100) / F.lit(100.0))
    return _drained(spark, sinks.alert_lines(scored))


from flowloom.catalog.file_queries import QUERIES as FILE_QUERIES  # noqa: E402

QUERIES.update(FILE_QUERIES)
