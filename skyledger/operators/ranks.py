"""Exact ranks and quantiles without sorting a whole group in one task.

Rows are first reduced to distinct values with counts, spread over the cluster by value. Spark's range partitioner
samples those and deals them into ordered parts of about equal size, however the values lie; running counts over the
parts (few rows) plus running counts inside each part give every value its exact rank.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.operators.lineage import settle


def ranged_levels(
    df: DataFrame, keys: list[str], value: str, parts: int | None, sums: dict[str, Column], bounds: str | None = None
) -> DataFrame:
    """One row per (keys, value) with each sum and its ``_bucket``, the place of its part in the order of keys and value.

    The parts are written, so that all that follows sees the same ones.
    """
    edges = [F.min(bounds).alias("_first"), F.max(bounds).alias("_last")] if bounds else []
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, value)
        .agg(*[c.alias(n) for n, c in sums.items()], *edges)
    )
    return settle(levels.repartitionByRange(parts, *keys, value).withColumn("_bucket", F.spark_partition_id()), "levels")


def running_levels(
    df: DataFrame, keys: list[str], value: str, sums: dict[str, Column], bounds: str | None = None, parts: int | None = None
) -> DataFrame:
    """One row per (keys, value) with each sum, its ``<name>_below`` and its ``<name>_total``.

    With ``bounds`` the rows also hold the smallest and largest ``bounds`` as ``_first``, ``_last``.
    """
    levels = ranged_levels(df, keys, value, parts, sums, bounds)
    names = list(sums)
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = (
        levels.groupBy(*keys, "_bucket")
        .agg(*[F.sum(n).alias(f"_s_{n}") for n in names])
        .select(
            *keys,
            "_bucket",
            *[F.coalesce(F.sum(f"_s_{n}").over(by_bucket), F.lit(0)).alias(f"_b_{n}") for n in names],
            *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in names],
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        levels.join(totals, [*keys, "_bucket"])
        .withColumns({f"{n}_below": F.col(f"_b_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names})
        .drop("_bucket", *[f"_b_{n}" for n in names])
    )


def order_statistics(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple], parts: int | None = None, bounds: str | None = None
) -> DataFrame:
    """Per key and name: the two order statistics around a probability and the step between them.

    ``wanted`` maps an output name to (column, probability), or (column, probability,
    "descending") to count from the largest value down. ``<name>_lo``, ``<name>_hi`` and
    ``<name>_at`` come back, and per measured column its non-null count ``_n_<column>`` and total
    ``_sum_<column>``.
    """
    measures = sorted({w[0] for w in wanted.values()})
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in measures])
    long = df.select(*keys, *([bounds] if bounds else []), F.explode(pairs).alias("_p"))
    long = long.withColumns({"_m": F.col("_p.m"), "_v": F.col("_p.v")}).drop("_p")
    levels = running_levels(long, [*keys, "_m"], "_v", {"n": F.count(F.lit(1))}, bounds, parts)
    outputs = []
    above = F.col("n_total") - F.col("n_below") - F.col("n")
    for name, (column, p, *direction) in wanted.items():
        at = F.lit(p) * (F.col("n_total") - 1)
        start = above if direction == ["descending"] else F.col("n_below")
        own = F.col("_m") == column
        hit = lambda r: own & (start <= r) & (r < start + F.col("n"))
        outputs += [
            F.max(F.when(hit(F.floor(at)), F.col("_v"))).alias(f"{name}_lo"),
            F.max(F.when(hit(F.ceil(at)), F.col("_v"))).alias(f"{name}_hi"),
            F.max(F.when(own, at - F.floor(at))).alias(f"{name}_at"),
        ]
    for m in measures:
        outputs += [
            F.max(F.when(F.col("_m") == m, F.col("n_total"))).alias(f"_n_{m}"),
            F.sum(F.when(F.col("_m") == m, F.col("_v") * F.col("n"))).alias(f"_sum_{m}"),
        ]
    if bounds:
        outputs += [F.min("_first").alias("_first"), F.max("_last").alias("_last")]
    return levels.groupBy(*keys).agg(*outputs)


def interpolate(name: str) -> Column:
    lo, hi, at = F.col(f"{name}_lo"), F.col(f"{name}_hi"), F.col(f"{name}_at")
    return lo + (hi - lo) * at


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], parts: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles per key."""
    stats = order_statistics(df, keys, wanted, parts)
    return stats.select(*keys, *[interpolate(n).alias(n) for n in wanted])


def percent_rank(df: DataFrame, keys: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """(rank - 1) / (n - 1) within the key, ties share the lowest rank; null stays null."""
    levels = running_levels(df, keys, value, {"_n": F.count(F.lit(1))}, parts=parts)
    share = F.when(F.col("_n_total") > 1, F.col("_n_below") / (F.col("_n_total") - 1)).otherwise(F.lit(0.0))
    ranked = levels.select(*keys, value, share.alias(out))
    return df.join(ranked, [*keys, value], "left")
