"""Station thresholds, hazard state and the next-day target."""

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.columns import fahrenheit_to_celsius, floor_at, mph_to_kmh
from skyledger.functions.hazards import (
    current_risk, extreme_cold, extreme_heat, heat_index, hybrid_risk, sst_air_diff, wet_bulb, wind_chill,
)
from skyledger.operators.chunks import CHUNK, attach, chunk_bounds
from skyledger.operators.rolling import Frame, rain, rolling
from skyledger.schema import STATION

LIMITS = ["t95", "t05", "drought75", "flood90", "wind90"]


def drought(mean_rain: Column, recent_rain: Column) -> Column:
    """How far the 30-row mean of rain lies below the station's average of it."""
    return floor_at(mean_rain - recent_rain, 0.0)


def drought_index(df: DataFrame) -> DataFrame:
    framed = rolling(rain(df), [Frame("_M", "mean", "_P", 30)], chunked=True).drop("_P")
    means = framed.groupBy(STATION).agg(F.avg("_M").alias("_mean"), *chunk_bounds())
    placed = attach(framed, means)
    return placed.withColumn("DROUGHT_IDX", drought(F.col("_mean"), F.col("_M"))).drop("_mean", "_M", CHUNK)


def station_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact, linearly interpolated; a station's distinct values are bounded by its days."""
    return df.groupBy(STATION).agg(*[
        F.percentile(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), p).alias(n)
        for n, (c, p) in wanted.items()
    ])


def station_thresholds(windows: DataFrame) -> DataFrame:
    """Per station, from one pass: mean of the 30-row rain mean and the five risk limits.

    The drought index falls as the rain mean rises, so its upper quartile comes from the mirrored order statistics of
    the rain mean and needs no second pass once the station's average is known. A station's values are bounded by the
    calendar.
    """
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    stats = windows.groupBy(STATION).agg(
        *chunk_bounds(), F.avg("_M").alias("_mean_M"), F.sort_array(F.collect_list(known("_M"))).alias("_rain"),
        *[F.percentile(known(c), p).alias(n) for n, (c, p) in {
            "t95": ("TAVG", 0.95), "t05": ("TAVG", 0.05), "flood90": ("FLOOD_RISK_IDX", 0.90), "wind90": ("WIND_RISK_IDX", 0.90)}.items()],
    )
    last = F.size("_rain") - 1
    at = F.lit(0.75) * last
    low, high = (drought(F.col("_mean_M"), F.get("_rain", (last - f(at)).cast("int"))) for f in (F.floor, F.ceil))
    return stats.withColumn("drought75", low + (high - low) * (at - F.floor(at))).drop("_rain")


def weather_indices(df: DataFrame) -> DataFrame:
    """The indices that need no threshold of the station."""
    temp, dew = F.col("TAVG"), fahrenheit_to_celsius(F.col("DEWPOINT_F"))
    return df.withColumns({
        "HEAT_INDEX": heat_index(temp, dew),
        "WIND_CHILL": wind_chill(temp, mph_to_kmh(F.col("WINDSPEED_MPH"))),
        "WET_BULB": wet_bulb(temp, dew),
        "SST_AIR_DIFF": sst_air_diff(temp, F.col("SST")),
    })


def hazard_state(windows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Indices, today's flags and the next row's hazard state as ``RISK_ENGINEERED``.

    ``windows`` may hold the ``weather_indices`` already.
    """
    placed = attach(windows if "WET_BULB" in windows.columns else weather_indices(windows), thresholds)
    limits = {n: F.col(n) for n in LIMITS}
    temp = F.col("TAVG")
    coming = F.col("_NEXT")
    tomorrow = current_risk(
        coming["T"], drought(F.col("_mean_M"), coming["M"]), coming["FLOOD"], coming["WIND"], limits
    )
    today = drought(F.col("_mean_M"), F.col("_M"))
    return placed.withColumns({
        "DROUGHT_IDX": today,
        "EXTREME_HEAT": extreme_heat(temp, limits["t95"]),
        "EXTREME_COLD": extreme_cold(temp, limits["t05"]),
        "CURRENT_RISK": current_risk(temp, today, F.col("FLOOD_RISK_IDX"), F.col("WIND_RISK_IDX"), limits),
        "RISK_ENGINEERED": F.when(coming.isNotNull(), tomorrow),
    }).drop("_NEXT", "_M", "_P", "_mean_M", *LIMITS, CHUNK)


def with_target(df: DataFrame) -> DataFrame:
    """``RISK``: the label where coverage exists, the engineered next-day state elsewhere."""
    if not {"EVENT_LABEL", "EVENT_LABEL_AVAILABLE"} <= set(df.columns):
        return df.withColumn("RISK", F.col("RISK_ENGINEERED"))
    return df.withColumn(
        "RISK", hybrid_risk(F.col("RISK_ENGINEERED"), F.col("EVENT_LABEL"), F.col("EVENT_LABEL_AVAILABLE"))
    )


def hazard_days(state: DataFrame) -> DataFrame:
    """Share of hazardous days and of next-day targets per station."""
    return state.groupBy(STATION).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("CURRENT_RISK").cast("long").alias("hazard_days"),
        F.avg("CURRENT_RISK").alias("hazard_rate"),
        F.avg("RISK_ENGINEERED").alias("next_day_rate"),
        F.max("DROUGHT_IDX").alias("worst_drought"),
    )
