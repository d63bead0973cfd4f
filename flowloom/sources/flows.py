"""Batch sources: flow CSV and JSON, log JSON, labelled tables, range lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions import coerce
from flowloom.operators.dataset import canonical_names
from flowloom.operators.scan import Running, sorted_scan
from flowloom.schemas import (
    FLOW_FIELDS, FLOW_TEXT_SCHEMA, LABELLED_FIELDS, LABELLED_SCHEMA, LOG_KINDS, LOG_RENAMES, LOG_SCHEMA, struct_of)
from flowloom.session import cut_lineage
from flowloom.sources.arrival import line_session, placed_lines

CORRUPT = "_corrupt"
# fixed values: capture excludes management and link-layer control records
EXCLUDED_CAPTURE = ["man", "llc"]


# --- filters shared by batch and stream -----------------------------------------

def captured(flows: DataFrame) -> DataFrame:
    """Drop management and LLC records."""
    return flows.where(~F.coalesce(F.lower("proto"), F.lit("")).isin(EXCLUDED_CAPTURE))


def timed(df: DataFrame, time: str) -> DataFrame:
    """Drop rows without a time."""
    return df.where(F.col(time).isNotNull())


def without_header(flows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop rows that repeat the column names (all, or ``names``), wherever a header appears.

    Rows with a blank or unreadable time are data: they stay, and their time becomes null.
    """
    repeats = reduce(lambda x, y: x & y, [
        F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) == c.lower() for c in names or flows.columns])
    return flows.where(~repeats)


# --- normalisation -----------------------------------------------------------------

def normalize_flows(flows: DataFrame) -> DataFrame:
    """Typed sensor-A flows from text records.

    ``stime`` and ``ltime`` become whole seconds (ties to even); the unrounded start stays
    available as ``stime_us``.
    """
    flows = canonical_names(flows)
    typed = {f.name: f.dataType for f in struct_of(FLOW_FIELDS)}

    def column(c: str) -> Column:
        if c in ("stime", "ltime"):
            return coerce.half_even_seconds(coerce.epoch_seconds(F.col(c)))
        if c in ("sport", "dport"):
            return coerce.port_number(F.col(c))
        if c in typed and isinstance(typed[c], T.LongType):
            return F.col(c).try_cast("double").cast("bigint")
        if c in typed and not isinstance(typed[c], T.StringType):
            return coerce.lenient_double(F.col(c))
        return F.col(c)
    return flows.select(*[column(c).alias(c) for c in flows.columns],
                        coerce.epoch_micros(F.col("stime")).alias("stime_us"))


def normalize_logs(logs: DataFrame) -> DataFrame:
    """Canonical sensor-B records: plain names, integer time, numeric ports, scalar service."""
    present = set(logs.columns)
    renamed = logs.withColumnsRenamed({a: b for a, b in LOG_RENAMES.items() if a in present})
    kinds = dict(renamed.dtypes)
    service = F.col("service")
    if kinds.get("service", "string").startswith("array"):
        service = F.get(service, F.lit(0))
    else:
        # a list-valued service read into a text column arrives as JSON text
        service = F.when(service.startswith("["), F.get(F.from_json(service, "array<string>"), F.lit(0))) \
            .otherwise(service)
    return (renamed.withColumns({
        "ts_us": coerce.epoch_micros(F.col("ts")),
        "orig_p": coerce.port_number(F.col("orig_p")), "resp_p": coerce.port_number(F.col("resp_p")),
        "service": service, "zeek_log": F.lower("zeek_log")}))


def union_logs(by_kind: dict[str, DataFrame]) -> DataFrame:
    """Logs of differing columns as one frame tagged with their kind."""
    tagged = [df.withColumn("zeek_log", F.lit(kind)) for kind, df in by_kind.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)


# --- batch readers --------------------------------------------------------------------

def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-less sensor-A CSV in the declared field order, as text."""
    return without_header(spark.read.schema(FLOW_TEXT_SCHEMA).csv(path))


def parse_flow_lines(lines: DataFrame) -> DataFrame:
    """Typed flows of placed lines (``value``, ``seq``); blank lines, headers and management rows go."""
    text = ", ".join(f"`{f.name}` string" for f in FLOW_TEXT_SCHEMA)
    kept = lines.where(F.length(F.trim("value")) > 0).select(F.from_csv("value", text).alias("r"), "seq").select("r.*", "seq")
    return captured(normalize_flows(without_header(kept, FLOW_TEXT_SCHEMA.names)))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Log records of placed lines (``value``, ``seq``); comment, blank and broken lines are skipped.

    Every record that parses is kept, whatever fields it lacks.
    """
    marked = T.StructType([*LOG_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    kept = lines.where((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#"))
    return kept.select(parsed.alias("r"), "seq").select("r.*", "seq").where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_flow_lines(spark: SparkSession, path: str) -> DataFrame:
    """Sensor-A CSV files as typed flows with the place of their line in ``seq``, as the stream source gives them."""
    return parse_flow_lines(placed_lines(line_session(spark).read.text(path)))


def read_log_lines(spark: SparkSession, root: str) -> DataFrame:
    """Sensor-B JSON logs, one folder per kind, with the place of their line in ``seq``, as the stream source gives them."""
    reading = line_session(spark)
    return normalize_logs(union_logs({
        kind: parse_log_lines(placed_lines(reading.read.text(f"{root}/{kind}"))) for kind in LOG_KINDS}))


def read_labelled_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
                      infer: bool = False) -> DataFrame:
    """Labelled CSV files with a header; a folder is read as one positional union."""
    reader = spark.read.option("header", True)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    return reader.option("enforceSchema", True).schema(schema or LABELLED_SCHEMA).csv(path)


def read_replaced_header_csv(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """CSV whose header is replaced by declared names; rows with too many fields are skipped.

    Short rows are kept and padded with nulls.
    """
    names = names or LABELLED_FIELDS
    text = T.StructType([*struct_of(names, text=True).fields, T.StructField("__over", T.StringType()),
                         T.StructField(CORRUPT, T.StringType())])
    rows = (spark.read.schema(text).option("header", True).option("enforceSchema", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("columnPruning", False).csv(path))
    # One spare column: a row with exactly one field too many fills the schema and is not
    # flagged; longer ones fill the spare column or show it in the flagged raw text.
    raw = F.col(CORRUPT)
    extra_blank = ~F.contains(raw, F.lit('"')) & (F.size(F.split(raw, ",")) > len(names))
    kept = rows.where(raw.isNotNull() & F.col("__over").isNull() & ~extra_blank)
    declared = {f.name: f.dataType for f in struct_of(names)}
    return kept.select(*[F.col(n).try_cast(declared[n]).alias(n) for n in names])


def read_flow_json(spark: SparkSession, path: str) -> DataFrame:
    """Sensor-A JSON lines for reconciliation: ``a_seq``, ``a_us``, ``line``.

    Blank and broken lines and rows without a time are skipped; the time is ``Stime``
    unless it is empty, then ``stime``.
    """
    text = spark.read.text(path)
    raw = F.coalesce(F.nullif(F.get_json_object("value", "$.Stime"), F.lit("")), F.get_json_object("value", "$.stime"))
    return (numbered(text, "a_seq").select("a_seq", coerce.micros_of_number(raw).alias("a_us"),
                                           F.col("value").alias("line"))
            .where(F.col("a_us").isNotNull()))


def read_log_json(spark: SparkSession, path: str) -> DataFrame:
    """Sensor-B JSON lines for reconciliation; unreadable ones stay with a null time."""
    text = spark.read.text(path).where(F.length("value") > 0)
    return numbered(text, "z_seq").select(
        "z_seq", coerce.micros_of_number(F.get_json_object("value", "$.ts")).alias("z_us"), F.col("value").alias("line"))


# Rows of one file block, as a power of two.
BLOCK_ROWS = 33


def numbered(text: DataFrame, name: str) -> DataFrame:
    """Ascending number in the order of file paths, and of lines inside a file; gaps are left.

    Blocks of files are few, so only they are ranked; a row adds its place inside its block.
    The order does not depend on how the reader packs files into tasks.
    """
    columns = text.columns
    tagged = text.select("*", F.col("_metadata.file_path").alias("__file"),
                         F.col("_metadata.file_block_start").alias("__start"),
                         F.monotonically_increasing_id().bitwiseAND(F.lit((1 << BLOCK_ROWS) - 1)).alias("__local"))
    ranked = sorted_scan(tagged.select("__file", "__start").distinct(), [], ["__file", "__start"],
                         [Running("__rank", F.lit(1).cast("bigint"))])
    return tagged.join(ranked, ["__file", "__start"]).select(
        *columns, (F.shiftleft("__rank", BLOCK_ROWS) + F.col("__local")).alias(name))


def joint_arrival(flows: DataFrame, logs: DataFrame, flow_order: list[str], log_order: list[str],
                  name: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Both sensors with one arrival number, unique over both: ``flow_order`` and ``log_order`` hold
    the arrival time and what breaks its ties (a line's place, or topic partition and offset).

    Numbers follow the two orders merged by time, a flow before a log record of the same time, null
    times first. Rows travel through the numbering whole, so none is lost or doubled where order values
    repeat; rows equal in them are ordered by their contents. A hot time is spread like any other. A column
    ``name`` of the input is replaced.
    """
    if len(flow_order) != len(log_order):
        raise ValueError("both orders need the same number of columns")
    order = [f"__o{i}" for i in range(len(flow_order))]

    def whole(df: DataFrame, columns: list[str], sensor: int) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c != name])
        return df.select(F.lit(sensor).alias("__s"), *[F.col(c).alias(o) for c, o in zip(columns, order)],
                         F.xxhash64(*df.columns).alias("__tie"), row.alias(f"__row{sensor}"))
    both = whole(flows, flow_order, 0).unionByName(whole(logs, log_order, 1), allowMissingColumns=True)
    # written once: rows equal in all columns could swap numbers between two readers
    numbered_rows = cut_lineage(sorted_scan(both, [], [order[0], "__s", *order[1:], "__tie"],
                                            [Running(name, F.lit(1).cast("bigint"))]), required=True)

    def back(sensor: int) -> DataFrame:
        return numbered_rows.where(F.col("__s") == sensor).select(f"__row{sensor}.*", name)
    return back(0), back(1)


def read_ranges(spark: SparkSession, path: str, provider: str, cidr_key: str, list_key: str = "prefixes") -> DataFrame:
    """Provider range list from a local JSON snapshot; entries without the key are skipped."""
    doc = spark.read.text(path, wholetext=True)
    entry = f"struct<`{cidr_key}`:string>"
    items = F.explode(F.from_json("value", f"struct<`{list_key}`:array<{entry}>>")[list_key])
    return (doc.select(items.alias("e")).select(F.lit(provider).alias("provider"), F.col(f"e.{cidr_key}").alias("cidr"))
            .where("cidr is not null"))
