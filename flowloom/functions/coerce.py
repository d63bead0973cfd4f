"""Lenient type coercions shared by every input path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: integer, hexadecimal and general number texts
DECIMAL_TEXT = r"^\s*[+-]?[0-9]+\s*$"
HEX_TEXT = r"^0[xX][0-9a-fA-F]+\s*$"
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
# digits of a hexadecimal number that fits a bigint
HEX_DIGITS = 15


def epoch_seconds(c: Column) -> Column:
    """Epoch seconds from a number, a numeric text or a date text; otherwise null."""
    text = c.cast("string")
    return F.coalesce(text.try_cast("double"),
                      F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6))


def epoch_micros(c: Column) -> Column:
    """Integer microseconds, the only time form that joins use."""
    return F.round(epoch_seconds(c) * F.lit(1e6), 0).cast("bigint")


def micros_of_number(c: Column) -> Column:
    """Integer microseconds of numeric text; null for anything else."""
    return F.round(c.try_cast("double") * F.lit(1e6), 0).cast("bigint")


def half_even_seconds(c: Column) -> Column:
    """Whole seconds, ties to the even second."""
    return F.bround(c, 0).cast("bigint")


def port_number(c: Column) -> Column:
    """Port from decimal or ``0x`` text; anything else, numbers too long for a bigint included, is 0."""
    text = c.cast("string")
    digits = F.ltrim(F.substr(F.trim(text), F.lit(3)), F.lit("0"))
    return F.coalesce(
        F.when(text.rlike(HEX_TEXT) & (F.length(digits) <= HEX_DIGITS), F.conv(digits, 16, 10).try_cast("bigint"))
        .when(text.rlike(DECIMAL_TEXT), F.trim(text).try_cast("bigint")),
        F.lit(0).cast("bigint"))


def lenient_double(c: Column) -> Column:
    """Double, null where the text is not a number; ``nan`` and type suffixes such as ``2d`` are none."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_TEXT), F.nanvl(text.try_cast("double"), F.lit(None).cast("double")))


def double_of(name: str, kind: str) -> Column:
    """:func:`lenient_double` without the way over text where the column is a number already."""
    if kind in ("string", "boolean"):
        return lenient_double(F.col(name))
    return F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double"))


def scoring_float(c: Column) -> Column:
    """Float for scoring, 0 where the text is not a number."""
    return F.coalesce(c.try_cast("float"), F.lit(0.0).cast("float"))


def label_int(c: Column) -> Column:
    """Label as int, -1 where it is missing or not a number."""
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(-1))


def class_name(label: Column) -> Column:
    return F.when(label == 1, F.lit("Attack")).otherwise(F.lit("Normal"))


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Lenient numeric cast of the listed columns that exist, in one projection."""
    wanted, kinds = set(cols), dict(df.dtypes)
    return df.select(*[double_of(c, kinds[c]).alias(c) if c in wanted else F.col(c) for c in df.columns])


def cast_and_fill(df: DataFrame, cols: list[str], fill: float = -1.0) -> DataFrame:
    """Double cast plus null fill of the listed columns that exist."""
    wanted, kinds = set(cols), dict(df.dtypes)
    return df.select(*[
        F.coalesce(double_of(c, kinds[c]), F.lit(fill)).alias(c) if c in wanted else F.col(c)
        for c in df.columns])


def missing_columns(df: DataFrame, cols: list[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in cols if c not in present]


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Projection onto ``cols``; raises with the list of absent names."""
    absent = missing_columns(df, cols)
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df.select(*cols)
