"""Enrichment of conn records with the http and ftp records of their connection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.keys import four_tuple, has_four_tuple
from flowloom.operators.scan import BLOCK_WIDTH, Running, keyed_scan

TTL_MICROS = 30 * 1_000_000
_ENDS = ("orig_h", "orig_p", "resp_h", "resp_p")
_HTTP = ["trans_depth", "response_body_len", "method"]
_FTP = ["user_name", "password", "command"]


def conn_enrich(logs: DataFrame, ttl: int = TTL_MICROS, width: int = BLOCK_WIDTH) -> DataFrame:
    """Each conn record takes the latest http and ftp record of its 4-tuple.

    Only records since the previous conn of the tuple and not older than ``ttl`` count; a
    conn consumes what it takes. Rows without a complete 4-tuple are dropped.
    """
    kind = F.lower(F.col("zeek_log"))
    rows = logs.where(has_four_tuple(*_ENDS)).withColumn("__tuple", four_tuple(*_ENDS))

    def latest(log, cols):
        defaults = [F.coalesce(F.col(c), F.lit(0).cast(rows.schema[c].dataType) if c in _HTTP[:2] else F.lit(""))
                    .alias(c) for c in cols]
        return F.when(kind == log, F.struct("seq", "ts_us", *defaults))

    scanned = keyed_scan(rows, ["__tuple"], "seq", [
        Running("__http", latest("http", _HTTP), "last", inclusive=False),
        Running("__ftp", latest("ftp", _FTP), "last", inclusive=False),
        Running("__conn", F.when(kind == "conn", F.col("seq")), "last", inclusive=False),
    ], width)

    def taken(log, col):
        fresh = ((F.col(f"{log}.seq") > F.coalesce(F.col("__conn"), F.lit(-1 << 62)))
                 & (F.col(f"{log}.ts_us") >= F.col("ts_us") - ttl))
        return F.when(fresh, F.col(f"{log}.{col}")).alias(col)

    kept = [c for c in logs.columns if c not in {*_HTTP, *_FTP}]
    return scanned.where(kind == "conn").select(
        *kept, *[taken("__http", c) for c in _HTTP], *[taken("__ftp", c) for c in _FTP])
