"""Column expressions that enrich merged and scored flows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: decision and severity thresholds
ATTACK_PROBABILITY = 0.5
HIGH_PROBABILITY = 0.70
NO_SERVICE = "-"


def same_endpoint(saddr="saddr", sport="sport", daddr="daddr", dport="dport") -> Column:
    """1 where source and destination share address and port."""
    same = F.col(saddr).eqNullSafe(F.col(daddr)) & F.col(sport).eqNullSafe(F.col(dport))
    return same.cast("int")


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def ftp_login(user: Column, password: Column) -> Column:
    """1 where both user and password are non-blank."""
    return (_filled(user) & _filled(password)).cast("int")


def ftp_command_present(command: Column) -> Column:
    return _filled(command).cast("int")


def service_name(kind: Column, service: Column) -> Column:
    """http and ftp logs name their service; conn rows default to ``-``."""
    return F.when(kind.isin("http", "ftp"), kind).otherwise(F.coalesce(service, F.lit(NO_SERVICE)))


def first_service(service: Column) -> Column:
    """Scalar service from a list-valued one."""
    return F.get(service, F.lit(0))


def flow_text(saddr="saddr", sport="sport", daddr="daddr", dport="dport") -> Column:
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(text(saddr), F.lit(":"), text(sport), F.lit(" -> "), text(daddr), F.lit(":"), text(dport))


def is_attack(probability: Column) -> Column:
    return probability >= ATTACK_PROBABILITY


def verdict(probability: Column, reason: Column) -> Column:
    """``attack``, ``ignored(<reason>)`` or ``normal``."""
    return (F.when(is_attack(probability) & reason.isNotNull(),
                   F.concat(F.lit("ignored("), reason, F.lit(")")))
            .when(is_attack(probability), F.lit("attack"))
            .otherwise(F.lit("normal")))


def severity(probability: Column, reason: Column) -> Column:
    """``high`` or ``low`` for reported attacks, null otherwise."""
    reported = is_attack(probability) & reason.isNull()
    return F.when(reported & (probability >= HIGH_PROBABILITY), F.lit("high")).when(reported, F.lit("low"))


def latency_seconds(event_time: Column, now: Column | None = None) -> Column:
    """Seconds between ``now`` and the event; 0 where the event time is not a number."""
    now = F.unix_micros(F.current_timestamp()) / F.lit(1e6) if now is None else now
    return F.coalesce(now - event_time.try_cast("double"), F.lit(0.0))


def latency_text(event_time: Column, now: Column | None = None) -> Column:
    """Latency with four decimals and unit; ``N/A`` where the event time is missing."""
    now = F.unix_micros(F.current_timestamp()) / F.lit(1e6) if now is None else now
    return F.when(event_time.isNull(), F.lit("N/A")).otherwise(
        F.format_string("%.4fs", now - event_time.try_cast("double")))


def csv_line(cols: list[str], present: list[str]) -> Column:
    """Comma separated positions; missing columns and null values print empty."""
    known = set(present)
    return F.concat_ws(",", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")) if c in known else F.lit("") for c in cols])
