"""Flow keys of both sensors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PORTLESS = "icmp"
ABSENT = "?"


def _part(c: Column) -> Column:
    # concat_ws drops nulls, which would make different keys collide
    return F.coalesce(c.cast("string"), F.lit(ABSENT))


def _key(proto: Column, src: Column, sport: Column, dst: Column, dport: Column) -> Column:
    return (F.when(proto == PORTLESS, F.concat_ws("|", proto, _part(src), _part(dst)))
            .otherwise(F.concat_ws("|", proto, _part(src), _part(sport), _part(dst), _part(dport))))


def flow_key(proto="proto", saddr="saddr", sport="sport", daddr="daddr", dport="dport") -> Column:
    """Key of a sensor-A flow; icmp carries no ports."""
    name = F.lower(F.coalesce(F.col(proto), F.lit("")))
    return _key(name, F.col(saddr), F.col(sport), F.col(daddr), F.col(dport))


def log_key(kind="zeek_log", proto="proto", orig_h="orig_h", orig_p="orig_p",
            resp_h="resp_h", resp_p="resp_p") -> Column:
    """Key of a sensor-B record; http and ftp logs name no protocol and are tcp."""
    name = (F.when(F.lower(F.col(kind)).isin("http", "ftp"), F.lit("tcp"))
            .otherwise(F.lower(F.coalesce(F.col(proto), F.lit("")))))
    return _key(name, F.col(orig_h), F.col(orig_p), F.col(resp_h), F.col(resp_p))


def four_tuple(src: str, sport: str, dst: str, dport: str) -> Column:
    return F.concat_ws(":", F.col(src), F.col(sport).cast("string"), F.col(dst), F.col(dport).cast("string"))


def has_four_tuple(src: str, sport: str, dst: str, dport: str) -> Column:
    """True where no part is null, empty or zero."""
    def present(c):
        text = F.col(c).cast("string")
        return text.isNotNull() & ~text.isin("", "0")
    return present(src) & present(sport) & present(dst) & present(dport)
