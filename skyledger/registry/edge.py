"""One output shape for a query and its SQL: names, types and rounding come from one spec.

A spec is a list of ``name:kind`` with kinds f (double, 4 decimals), n (bigint), i (int) and
s (string; dates are written as yyyy-MM-dd).
"""

from pyspark.sql import DataFrame, functions as F

SPARK_KINDS = {"n": "bigint", "i": "int", "s": "string"}
SQL_KINDS = {"n": "BIGINT", "i": "INTEGER", "s": "VARCHAR"}
# Moves exact decimal ties off the rounding edge, where the engines differ in the last bit.
NUDGE = 0.0000003
RENAMED = {"station": "City_ID", "d": "Date"}


def fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    present = {c.lower(): c for c in df.columns}
    columns = []
    for name, kind in fields(spec):
        source = F.col(present.get(name.lower()) or RENAMED[name])
        if kind == "f":
            rounded = F.round(source.cast("double") + NUDGE, 4)
            columns.append(F.when(rounded == 0, F.lit(0.0)).otherwise(rounded).alias(name))
        else:
            columns.append(source.cast(SPARK_KINDS[kind]).alias(name))
    return df.select(*columns)


def shape_sql(sql: str, spec: str) -> str:
    columns = []
    for name, kind in fields(spec):
        quoted = f'"{name}"'
        if kind == "f":
            value = f"ROUND(CAST({quoted} AS DOUBLE) + CAST({NUDGE:.7f} AS DOUBLE), 4)"
            columns.append(f"CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END AS {quoted}")
        else:
            columns.append(f"CAST({quoted} AS {SQL_KINDS[kind]}) AS {quoted}")
    head, body = split_with(sql)
    return f"{head}SELECT {', '.join(columns)} FROM (\n{body}\n) AS result"


def split_with(sql: str) -> tuple[str, str]:
    """Views (as written by ``proxies.over``) and the statement behind them."""
    mark = "\n-- statement\n"
    return sql.split(mark, 1) if mark in sql else ("", sql)
