"""Queries that go through files: inputs written from the given tables into the shared folder, then read by
the package's own sources, streams and model bundles."""

from __future__ import annotations

import time
import uuid

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.catalog.fixtures import flows, logs
from flowloom.functions import coerce
from flowloom.operators import categories, dataset
from flowloom.plans import training
from flowloom.schemas import CATEGORICAL_FIELDS, FLOW_FIELDS, LABELLED_FIELDS
from flowloom.session import SETTINGS, checkpoint_root, cut_lineage
from flowloom.sources import flows as sources
from flowloom.sources import sinks
from flowloom.streaming import match, sources as streams

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def folder(spark) -> str:
    root = checkpoint_root(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return f"{root}/{uuid.uuid4().hex}"


def seconds_text(micros: str):
    """Microseconds as seconds with six decimals."""
    return F.concat((F.col(micros) / 1_000_000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((F.col(micros) % 1_000_000).cast("string"), 6, "0"))


LOG_KINDS_IN_ORDER = ("conn", "ftp", "http")


def flow_schema(spark, sf):
    """Schema of typed flows, as the sources give them."""
    text = spark.createDataFrame([], sources.FLOW_TEXT_SCHEMA)
    return sources.normalize_flows(text).schema


def flow_texts(a: DataFrame, blank_times: bool = False) -> DataFrame:
    """Flows as the exporter writes them: text fields in declared order, some times blank if asked for."""
    time = seconds_text("stime_us")
    if blank_times:
        time = F.when(F.col("seq") % 17 == 0, F.lit("")).otherwise(time)
    return a.withColumn("stime", time).withColumn("ltime", (F.col("ltime") * 86400).cast("string")).select(
        *[F.col(c).cast("string").alias(c) for c in FLOW_FIELDS])


def write_flow_files(a: DataFrame, path: str, blank_times: bool = False) -> None:
    """Header-less CSV files, with a header row inside each as the exporter leaves it after a restart."""
    header = a.sparkSession.createDataFrame([tuple(FLOW_FIELDS)], sources.FLOW_TEXT_SCHEMA)
    flow_texts(a, blank_times).unionByName(header).write.option("emptyValue", "").csv(path)


def log_lines(z: DataFrame) -> DataFrame:
    """Log records as JSON lines."""
    fields = {"ts": F.col("ts_us") / 1e6, "proto": F.col("proto"), "id.orig_h": F.col("orig_h"), "id.orig_p": F.col("orig_p"),
              "id.resp_h": F.col("resp_h"), "id.resp_p": F.col("resp_p"),
              "service": F.when(F.col("service").isNotNull(), F.array("service", F.lit("x"))),
              "trans_depth": F.col("trans_depth"), "response_body_len": F.col("response_body_len"),
              "method": F.col("method"), "command": F.col("command"), "user": F.col("user_name"),
              "password": F.col("password")}
    return z.select("zeek_log", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("line"))


@query
def flow_csv_scan(spark, sf):
    path = folder(spark)
    write_flow_files(flows(spark, sf), path, blank_times=True)
    return sources.normalize_flows(sources.read_flow_csv(spark, path)).select(
        "stcpb", "proto", "saddr", "sport", "daddr", "dport", "ltime", "stime_us")


@query
def flow_json_scan(spark, sf):
    """Broken lines and flows without a time are skipped."""
    path = folder(spark)
    a = flows(spark, sf)
    line = F.when(F.col("seq") % 19 == 0, F.lit("{broken")).otherwise(
        F.to_json(F.struct(seconds_text("stime_us").cast("double").alias("stime"), "stcpb")))
    a.select(line.alias("line")).write.text(path)
    return sources.read_flow_json(spark, path).select(
        "a_us", F.get_json_object("line", "$.stcpb").cast("bigint").alias("stcpb"))


@query
def log_json_scan(spark, sf):
    """Unreadable lines stay with a null time; numbers rise with the order of the files."""
    path = folder(spark)
    z = logs(spark, sf).withColumn("part", F.col("seq") % 3)
    line = F.when(F.col("ts_us") % 23 == 0, F.lit("{broken")).otherwise(
        F.concat(F.lit('{"ts": '), seconds_text("ts_us"), F.lit("}")))
    lines = z.select("part", line.alias("line"))
    lines.write.partitionBy("part").text(path)
    return sources.read_log_json(spark, path).select("z_us", F.length("line").cast("bigint").alias("chars"))


@query
def labelled_csv_scan(spark, sf):
    path = folder(spark)
    named = flows(spark, sf).withColumnsRenamed({"saddr": "srcip", "daddr": "dstip", "dport": "dsport"})
    present = set(named.columns)
    named.select(*[F.col(c).cast("string").alias(c) if c in present else F.lit(None).cast("string").alias(c)
                   for c in LABELLED_FIELDS]).write.option("header", True).csv(path)
    return sources.read_labelled_csv(spark, path).select("stcpb", "srcip", "dsport", "dur", "label", "attack_cat", "service")


@query
def replaced_header_scan(spark, sf):
    """Every ninth row has a field too many and is skipped."""
    path = folder(spark)
    rows = flows(spark, sf).select("seq", F.col("proto").alias("one"), F.col("stcpb").alias("two"), F.col("label").alias("three"))
    long = F.col("seq") / 4 % 9 == 0
    rows.where(~long).drop("seq").write.option("header", True).csv(path)
    (rows.where(long).drop("seq").withColumns({"four": F.lit("extra"), "five": F.lit("more")})
     .write.mode("append").option("header", True).csv(path))
    return sources.read_replaced_header_csv(spark, path, ["proto", "stcpb", "label"])


@query
def csv_sink(spark, sf):
    path = folder(spark)
    sinks.write_csv(flows(spark, sf).select("seq", "proto", "sbytes", "attack_cat"), path, {"proto": "protocol"})
    return spark.read.schema("seq bigint, protocol string, sbytes bigint, attack_cat string").option(
        "header", True).csv(path)


@query
def range_file_load(spark, sf):
    path = folder(spark)
    hosts = flows(spark, sf).select(F.concat("saddr", F.lit("/32")).alias("ipv4Prefix")).distinct()
    # one entry per source address of the fixture, at most 50
    both = hosts.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("ipv4Prefix"))).alias("prefixes"))).alias("value"))
    both.coalesce(1).write.text(path)
    return sources.read_ranges(spark, path, "gcloud", "ipv4Prefix")


@query
def category_files(spark, sf):
    path = folder(spark)
    categories.save_category_map(categories.fit_category_index(flows(spark, sf), "state"), path)
    return categories.load_category_map(spark, path).select("value", "index")


@query
def required_columns(spark, sf):
    return coerce.require_columns(flows(spark, sf), ["seq", "proto", "dur"])


@query
def port_alias(spark, sf):
    drifting = flows(spark, sf).select("seq", F.col("dport").alias("dsport"))
    return dataset.canonical_names(drifting)


@query
def list_service(spark, sf):
    """A list-valued service is read as its first entry."""
    path = folder(spark)
    log_lines(logs(spark, sf)).where("zeek_log = 'conn'").select("line").write.text(path)
    parsed = spark.read.schema(streams.LOG_SCHEMA).json(path)
    return sources.normalize_logs(parsed.withColumn("zeek_log", F.lit("conn"))).select("ts_us", "orig_h", "service")


@query
def seeded_sort(spark, sf):
    return dataset.seeded_order(flows(spark, sf).select("seq"), "seq")


# --- streams over files -------------------------------------------------------------

def _log_folders(z: DataFrame, root: str) -> None:
    for kind in ("conn", "http", "ftp"):
        log_lines(z.where(F.col("zeek_log") == kind)).select("line").write.text(f"{root}/{kind}")


@query
def merge_from_files(spark, sf):
    """Both sensors' files, numbered jointly by arrival, through the stateful merge."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    root = folder(spark)
    a, z = flows(spark, sf), logs(spark, sf)
    write_flow_files(a, f"{root}/a")
    _log_folders(z, f"{root}/z")
    read_a = sources.captured(sources.normalize_flows(sources.read_flow_csv(spark, f"{root}/a")))
    read_z = sources.normalize_logs(sources.union_logs(
        {kind: spark.read.schema(streams.LOG_SCHEMA).json(f"{root}/z/{kind}") for kind in ("conn", "http", "ftp")}))
    read_a, read_z = sources.joint_arrival(read_a, read_z, ["stime_us", "stcpb"], ["ts_us", "response_body_len"])
    read_a.write.parquet(f"{root}/ordered_a")
    read_z.write.parquet(f"{root}/ordered_z")
    stream_a = spark.readStream.schema(read_a.schema).parquet(f"{root}/ordered_a")
    stream_z = spark.readStream.schema(read_z.schema).parquet(f"{root}/ordered_z")
    merged = match.stream_merge(stream_a, stream_z)
    (merged.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
     .trigger(availableNow=True).start().awaitTermination())
    got = match.unpack(spark.read.parquet(f"{root}/out"), flow_schema(spark, sf))
    return got.select("stcpb", "kind", "service", "trans_depth", "response_body_len", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd")


# Arrivals of a wave reach the sensors' folders before the stream is started again.
WAVES, WAVE_FILES = 3, 4


def stamp_new_files(spark, root: str, known: set[str], millis: int) -> None:
    """Give the files that appeared under ``root`` one modification time, so that only paths order them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    # the files of a fixture: a few dozen
    found = fs.listFiles(top, True)
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().startswith("part-") and path.toString() not in known:
            known.add(path.toString())
            fs.setTimes(path, millis, -1)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange(WAVE_FILES, "seq").sortWithinPartitions("seq")


@query
def stream_from_files(spark, sf):
    """The sensors' own streams into the stateful merge: lines are numbered as they land, and each wave of files meets
    a stream that was stopped and started again. Within a wave flows come first, then logs by kind."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   SETTINGS["spark.sql.streaming.stateStore.providerClass"])
    root = folder(spark)
    a, z = flows(spark, sf), logs(spark, sf)
    after = a.agg(F.coalesce(F.max("seq"), F.lit(0)) + 4).first()[0]
    known: set[str] = set()
    started = int(time.time() * 1000)
    for wave in range(WAVES):
        inside = F.floor(F.round(F.col("seq") / 4) * 4 * WAVES / after) == wave
        order = _in_order(a.where(inside))
        flow_texts(order).write.mode("append").option("emptyValue", "").csv(f"{root}/a")
        stamp_new_files(spark, f"{root}/a", known, started + 4 * wave)
        for k, kind in enumerate(LOG_KINDS_IN_ORDER):
            lines = log_lines(_in_order(z.where(inside & (F.col("zeek_log") == kind))))
            lines.select("line").write.mode("append").text(f"{root}/z/{kind}")
            stamp_new_files(spark, f"{root}/z/{kind}", known, started + 4 * wave + 1 + k)
        merged = match.stream_merge(streams.flow_stream(spark, f"{root}/a"), streams.log_stream(spark, f"{root}/z"))
        merged = match.unpack(merged, flow_schema(spark, sf))
        (merged.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/out").select(
        "stcpb", "kind", "service", "trans_depth", "response_body_len", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd")


@query
def micro_batches(spark, sf):
    """Files arrive four to a micro-batch; each batch states how many flows it held."""
    root = folder(spark)
    a = flows(spark, sf)
    for part in range(4):
        # so many files a batch
        flow_texts(a.where(F.col("seq") / 4 % 4 == part).repartition(WAVE_FILES)).write.mode("append").option(
            "emptyValue", "").csv(f"{root}/in")

    def count(batch: DataFrame, number: int) -> None:
        batch.groupBy().agg(F.count(F.lit(1)).alias("rows"), F.sum("stcpb").alias("stcpb")).withColumn(
            "batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/counts/{number}")
    (streams.flow_stream(spark, f"{root}/in", max_files=WAVE_FILES).writeStream.foreachBatch(count)
     .option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/counts/*").select("rows", "stcpb")


# --- model parts ---------------------------------------------------------------------

def _features(spark, sf):
    rows = flows(spark, sf).withColumn("service", F.when(F.col("dport") == 443, "ssl").otherwise("-"))
    return training.with_target(training.feature_columns(rows))


@query
def model_features(spark, sf):
    """Category indexes, pinned target, and the assembled vector as an array."""
    rows = _features(spark, sf)
    stages = training.pipeline(training.forest({"numTrees": 2, "maxDepth": 2})).getStages()[:-1]
    made = Pipeline(stages=stages).fit(rows).transform(rows)
    dense = training.dense_features(made)
    place = training.feature_order().index("dur")
    return dense.select("seq", "target", *[f"{c}_index" for c in CATEGORICAL_FIELDS],
                        F.size("features").cast("bigint").alias("width"),
                        F.get("features", F.lit(place)).cast("double").alias("dur"))


@query
def forest_checks(spark, sf):
    """What SQL can state of a searched, saved and reloaded forest."""
    # a table has fewer splits than there are cores, and all passes of the fit keep the partitions they find
    rows = cut_lineage(_features(spark, sf).repartition("seq"))
    train, test = training.split(rows, "seq")
    found = training.search(train, [{"numTrees": 3, "maxDepth": 3, "featureSubsetStrategy": "sqrt"}], "seq", folds=2,
                            parallelism=1).bestModel
    path = folder(spark)
    training.save_bundle(found, path)
    loaded, order = training.load_bundle(spark, path)
    one = training.attack_probability(found.transform(test)).select("seq", "target", "probability", "prediction")
    two = training.attack_probability(loaded.transform(test)).select("seq", F.col("probability").alias("again"))
    report = training.evaluate(found, test)
    share = F.greatest(F.avg("target"), 1 - F.avg("target"))
    accuracy = report["accuracy"].select("accuracy").first()[0]
    return one.join(two, "seq").agg(
        F.count(F.lit(1)).alias("test_rows"), F.sum(F.col("target").cast("bigint")).alias("attacks"),
        F.bool_and(F.col("probability").between(0, 1)).alias("in_range"),
        F.bool_and((F.col("prediction") == 1) == (F.col("probability") > 0.5)).alias("by_majority"),
        F.bool_and(F.col("probability") == F.col("again")).alias("same_after_load"),
        F.lit(len(order)).cast("bigint").alias("features"),
        (F.lit(accuracy) >= share - 0.02).alias("not_below_majority"))
