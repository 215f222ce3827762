"""Small column helpers used across the operators."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def no_nan(column: Column) -> Column:
    """NaN becomes null, so that aggregates and windows skip it."""
    return F.nanvl(column, F.lit(None).cast("double"))


def floor_at(column: Column, low: float) -> Column:
    """Lower bound that keeps null (``greatest`` would replace it)."""
    return F.when(column < low, F.lit(low)).otherwise(column)


def flag(condition: Column) -> Column:
    """1/0 integer; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def column_or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column, or a typed null where the frame does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def numeric(df: DataFrame, name: str) -> Column:
    """Column as double; text that does not parse becomes null."""
    return no_nan(F.col(name).try_cast("double"))


def row_mean(names: list[str]) -> Column:
    """Mean across columns of one row, skipping nulls."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    filled = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names])
    return F.try_divide(total, filled)


def micros(column: Column, zoned: bool) -> Column:
    """Microseconds on a common scale; zone-free timestamps never pass through the session's time zone."""
    if zoned:
        return F.unix_micros(column)
    whole = F.unix_date(F.to_date(column)) * F.lit(86400).cast("long") + F.hour(column) * 3600 + F.minute(column) * 60
    return whole * 1000000 + (F.extract(F.lit("SECOND"), column) * 1000000).cast("long")


def fahrenheit_to_celsius(column: Column) -> Column:
    return (column - 32) * 5.0 / 9.0


def celsius_to_fahrenheit(column: Column) -> Column:
    return column * 9.0 / 5.0 + 32


def mph_to_kmh(column: Column) -> Column:
    return column * 1.60934


def kmh_to_mph(column: Column) -> Column:
    return column / 1.60934


def display_name(code: Column) -> Column:
    """``NEW_YORK`` -> ``New York (NEW_YORK)``."""
    return F.concat(F.initcap(F.regexp_replace(code, "_", " ")), F.lit(" ("), code, F.lit(")"))
