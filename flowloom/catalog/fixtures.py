"""Both sensors' inputs derived from the ``events`` table.

Each view is written once as ``alias: expression`` text with two placeholders, so that
Spark and the SQL check read identical inputs: ``{US}`` microseconds of ``ts`` and
``{S}`` the string type name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_TOKENS = {"US": "unix_micros(cast(ts as timestamp))", "S": "string"}
DUCKDB_TOKENS = {"US": "epoch_us(ts)", "S": "varchar"}

_PROTO = "case user_id % 10 when 0 then 'icmp' when 1 then 'udp' when 2 then 'arp' else 'tcp' end"
_SADDR = "concat('10.0.0.', cast(user_id % 50 as {S}))"
_DADDR = ("case when user_id % 25 = 3 then concat('10.0.0.', cast(user_id % 50 as {S})) "
          "else concat('10.0.1.', cast(user_id % 7 as {S})) end")
_DPORT = ("cast(case event_type when 'purchase' then 80 when 'signup' then 21 when 'click' then 443 "
          "else 1024 + user_id % 5 end as bigint)")


def _gaps(value: str) -> str:
    """A measurement with missing values, -1 and 0 sprinkled in."""
    return (f"case when event_id % 13 = 0 then null when event_id % 11 = 0 then -1.0e0 "
            f"when event_id % 7 = 0 then 0.0e0 else {value} end")


# Sensor A: one flow per event. ltime is the day, so that the counters meet company.
FLOWS = {
    "seq": "event_id * 4",
    "proto": _PROTO,
    "saddr": _SADDR,
    "sport": "cast(1024 + user_id % 5 as bigint)",
    "daddr": _DADDR,
    "dport": _DPORT,
    "state": "case event_id % 5 when 0 then 'FIN' when 1 then 'CON' when 2 then 'INT' "
             "when 3 then 'REQ' else 'RST' end",
    "stime_us": "{US}",
    "stime": "{US} / 1000000.0e0",
    "ltime": "cast(floor({US} / 86400000000.0e0) as bigint)",
    "dur": "value",
    "spkts": "cast(event_id % 4 as bigint)",
    "dpkts": "cast(event_id % 8 as bigint)",
    "sbytes": "cast(floor(value * 100) as bigint)",
    "dbytes": "cast(floor(value * 50) as bigint)",
    "sttl": "cast(31 + user_id % 3 as bigint)",
    "dttl": "cast(29 + event_id % 2 as bigint)",
    "sload": "value * 8",
    "dload": "value * 4",
    "sloss": "cast(event_id % 3 as bigint)",
    "dloss": "cast(event_id % 2 as bigint)",
    "sintpkt": _gaps("value / 7"),
    "dintpkt": _gaps("value / 3"),
    "sjit": _gaps("value"),
    "djit": _gaps("value * 2"),
    "stcpb": "event_id * 1000",
    "dtcpb": "event_id * 500",
    "tcprtt": "value / 7 + 1",
    "synack": "value / 9 + 1",
    "ackdat": "value / 9 + 2",
    "smeansz": "value + 40",
    "dmeansz": "value + 20",
    "label": "cast(case when event_type = 'error' then 1 else 0 end as int)",
    "attack_cat": "case when event_type = 'error' then concat('cat', cast(event_id % 3 as {S})) end",
}

# Sensor B: one log record per event, up to 1 ms off its flow, some just before it.
# Every fourth record saw another source port and finds no flow (icmp ignores ports).
LOGS = {
    "seq": "event_id * 4 + case when event_id % 3 = 0 then -1 else 1 end",
    "zeek_log": "case event_type when 'purchase' then 'http' when 'signup' then 'ftp' else 'conn' end",
    "proto": _PROTO,
    "orig_h": _SADDR,
    "orig_p": "cast(1024 + user_id % 5 + case when event_id % 4 = 0 then 100 else 0 end as bigint)",
    "resp_h": _DADDR,
    "resp_p": _DPORT,
    "ts_us": "{US} + (event_id % 5 - 2) * 500",
    "service": "case when event_type = 'click' then 'ssl' end",
    "trans_depth": "cast(event_id % 3 as bigint)",
    "response_body_len": "cast(floor(value) as bigint)",
    "method": "case event_id % 3 when 0 then 'get' when 1 then 'POST' end",
    "command": "case when event_id % 2 = 0 then 'retr' else '' end",
    "user_name": "case when event_id % 4 <> 1 then 'u' else ' ' end",
    "password": "'p'",
}


def _fill(text: str, tokens: dict[str, str]) -> str:
    for name, value in tokens.items():
        text = text.replace("{" + name + "}", value)
    return text


def derive(events: DataFrame, columns: dict[str, str]) -> DataFrame:
    return events.selectExpr(*[f"{_fill(e, SPARK_TOKENS)} as {c}" for c, e in columns.items()])


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark.read.parquet(f"{sf_dir}/events.parquet"), FLOWS)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark.read.parquet(f"{sf_dir}/events.parquet"), LOGS)


def duckdb_view(columns: dict[str, str]) -> str:
    body = ", ".join(f"{_fill(e, DUCKDB_TOKENS)} as {c}" for c, e in columns.items())
    return f"select {body} from events"
