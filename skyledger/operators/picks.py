"""Pooling, sampling, top-k and appends."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from skyledger.schema import DAY, STATION


def pool_stations(frames: list[DataFrame]) -> DataFrame:
    """Frames with differing columns as one, in (day, station) order."""
    pooled = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return pooled.orderBy(DAY, STATION)


def sample_stations(ready: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` stations without replacement, in catalog order; 0 keeps all."""
    if not n:
        return ready.orderBy("station_id")
    drawn = ready.orderBy(F.xxhash64("station_id", F.lit(seed)), "station_id").limit(n)
    return drawn.orderBy("station_id")


def top_importances(importances: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` largest, in ascending order."""
    return importances.orderBy(F.col("importance").desc(), "feature").limit(k).orderBy("importance", "feature")


def recent_years(annual: DataFrame, k: int = 8) -> DataFrame:
    """The last ``k`` calendar years of each station's annual table."""
    last = annual.groupBy(STATION).agg(F.max("year").alias("_last"))
    return annual.join(last, STATION).filter(F.col("year") > F.col("_last") - k).drop("_last")


def since(df: DataFrame, day: str = "2018-01-01") -> DataFrame:
    return df.filter(F.col(DAY) >= F.to_date(F.lit(day)))


def default_chip(chips: DataFrame, bright: float = 0.15) -> DataFrame:
    """Index of the first bright positive chip, else of the first positive one, else 0."""
    positive = F.col("label") == 1
    return chips.agg(
        F.coalesce(
            F.min(F.when(positive & (F.col("max_reflectivity") > bright), F.col("index"))),
            F.min(F.when(positive, F.col("index"))),
            F.lit(0),
        ).alias("index")
    )


def append_observation(history: DataFrame, today: DataFrame) -> DataFrame:
    return history.unionByName(today, allowMissingColumns=True)
