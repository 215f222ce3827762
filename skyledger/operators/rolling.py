"""Row-based rolling features; short windows at the start of a station's history count."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.functions.columns import floor_at
from skyledger.functions.hazards import flood_risk, wind_risk
from skyledger.operators.chunks import CHUNK, COPY, carry, chunk_window, over_rows, with_chunk, with_neighbours
from skyledger.operators.lineage import settle
from skyledger.schema import DAY, SEQUENCE, SST_FILL_C, STATION


@dataclass(frozen=True)
class Frame:
    """``how`` over the last ``rows`` rows of ``source``, this row included."""

    out: str
    how: str
    source: str
    rows: int


def frame_column(frame: Frame, keys: list[str], order: list[str]) -> Column:
    window = chunk_window(keys, order).rowsBetween(-(frame.rows - 1), 0)
    source = F.col(frame.source)
    if frame.how == "sum":
        return F.sum(source).over(window)
    if frame.how == "max":
        return F.max(source).over(window)
    if frame.how == "mean":
        return F.avg(source).over(window)
    if frame.how == "anomaly":
        return source - F.avg(source).over(window)
    if frame.how == "drop":
        return floor_at(F.max(source).over(window) - source, 0.0)
    raise ValueError(frame.how)


def rolling(
    df: DataFrame, frames: list[Frame], leads: dict[str, str] | None = None, keys=(STATION,), order=(DAY,), chunked=False
) -> DataFrame:
    """All frames (and next-row values) in one shuffle and one sort."""
    keys, order = list(keys), list(order)
    columns = {f.out: frame_column(f, keys, order) for f in frames}
    place = chunk_window(keys, order)
    columns |= {out: F.lead(source, 1).over(place) for out, source in (leads or {}).items()}
    before = max([f.rows - 1 for f in frames], default=0)
    out = over_rows(df if CHUNK in df.columns else with_chunk(df, order[0]), columns, before, int(bool(leads)), keys, order)
    return out if chunked else out.drop(CHUNK)


def rain(df: DataFrame) -> DataFrame:
    """Rain with missing days as dry."""
    return df.withColumn("_P", F.coalesce("PRCP", F.lit(0.0)))


def rolling_rain(df: DataFrame) -> DataFrame:
    return rolling(rain(df), [Frame(f"PRCP_{n}D", "sum", "_P", n) for n in (3, 7, 14, 30)]).drop("_P")


def rolling_peaks(df: DataFrame) -> DataFrame:
    frames = [
        Frame("PRCP_MAX_7D", "max", "_P", 7),
        Frame("WIND_MAX_7D", "max", "WINDSPEED_MPH", 7),
        Frame("SATURATION_MAX_7D", "max", "SATURATION_PCT", 7),
    ]
    return rolling(rain(df), frames).drop("_P")


def pressure_drop(df: DataFrame) -> DataFrame:
    return rolling(df, [Frame("PRESSURE_DROP_3D", "drop", "PRESSURE_HPA", 3)])


ANOMALIES = [
    Frame("SOIL_MOISTURE_ANOM_30D", "anomaly", "SOIL_MOISTURE_VOL", 30),
    Frame("TEMP_ANOM_7D", "anomaly", "TAVG", 7),
    Frame("TEMP_ANOM", "anomaly", "TAVG", 30),
    Frame("PRCP_ANOM", "anomaly", "_P", 30),
]


def rolling_anomalies(df: DataFrame) -> DataFrame:
    return rolling(rain(df), ANOMALIES).drop("_P")


FEATURE_FRAMES = [
    *[Frame(f"PRCP_{n}D", "sum", "_P", n) for n in (3, 7, 14, 30)],
    Frame("PRCP_MAX_7D", "max", "_P", 7),
    Frame("WIND_MAX_7D", "max", "WINDSPEED_MPH", 7),
    Frame("PRESSURE_DROP_3D", "drop", "PRESSURE_HPA", 3),
    Frame("SATURATION_MAX_7D", "max", "SATURATION_PCT", 7),
    *ANOMALIES,
    Frame("_M", "mean", "_P", 30),
]


def panel_windows(filled: DataFrame) -> DataFrame:
    """Every window feature and the next row's risk inputs, in one pass over the filled panel.

    ``_M`` is the 30-row mean of rain. ``_NEXT`` holds what the next row's hazard state depends
    on, so that the target needs no second window once the station thresholds are known.
    """
    ready = rain(filled).withColumns({
        "FLOOD_RISK_IDX": flood_risk(F.col("PRCP"), F.col("SATURATION_PCT")),
        "WIND_RISK_IDX": wind_risk(F.col("WINDSPEED_MPH"), F.col("PRESSURE_HPA")),
    })
    framed = with_neighbours(with_chunk(ready), 29, 1).withColumns(
        {f.out: frame_column(f, [STATION], [DAY]) for f in FEATURE_FRAMES}
    )
    # A copied next row sees its own predecessors: they are in the chunk it was copied into.
    coming = F.struct(
        F.col("TAVG").alias("T"), F.col("_M").alias("M"),
        F.col("FLOOD_RISK_IDX").alias("FLOOD"), F.col("WIND_RISK_IDX").alias("WIND"),
    )
    following = F.lead(coming, 1).over(chunk_window([STATION], [DAY]))
    return framed.withColumn("_NEXT", following).filter(~F.col(COPY)).drop(COPY)


def next_day(df: DataFrame, column: str, out: str) -> DataFrame:
    """The next row's value per station; null on the station's last row."""
    return rolling(df, [], {out: column})


def sequences(df: DataFrame, length: int = 30, keys=(STATION, "split"), columns=None) -> DataFrame:
    """Per row with ``length`` predecessors inside its own (station, split): those rows as an array, and its TAVG.

    The filled rows are written once: their own windows read them twice, and no task holds the sort of the fill and that
    of the windows at a time.
    """
    columns = columns or SEQUENCE
    keys = list(keys)
    filled = carry(with_chunk(df).select(*keys, DAY, CHUNK, *columns), columns, keys).fillna(SST_FILL_C, subset=columns)
    filled = settle(filled, "filled")
    step = F.struct(*[F.col(c) for c in columns])
    window = chunk_window(keys, [DAY]).rowsBetween(-length, -1)
    out = over_rows(
        filled.select(*keys, DAY, CHUNK, *columns), {"sequence": F.collect_list(step).over(window)}, length, 0, keys
    )
    return out.filter(F.size("sequence") == length).select(*keys, DAY, "sequence", F.col("TAVG").alias("target"))


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows per station; the limit is applied on the map side before the shuffle."""
    newest = Window.partitionBy(STATION).orderBy(F.col(DAY).desc())
    return df.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= n)


STEP = "struct<_age:int," + ",".join(f"{c}:double" for c in SEQUENCE) + ">"


def scoring_sequences(history: DataFrame, current: DataFrame, length: int = 30) -> DataFrame:
    """Last ``length - 1`` history rows plus today's, padded in front with the first row.

    ``current`` holds (City_ID, TMAX, TMIN, PRCP); today's SST is the last known one.
    """
    history = history if "TAVG" in history.columns else history.withColumn("TAVG", (F.col("TMAX") + F.col("TMIN")) / 2)
    tail = last_rows(history, length - 1).select(STATION, "_age", *[F.col(c).cast("double").alias(c) for c in SEQUENCE])
    ocean = tail.filter(F.col("_age") == 1).select(STATION, F.col("SST").alias("_sst"))
    today = current.join(ocean, STATION, "left").withColumns({
        "TAVG": (F.col("TMAX") + F.col("TMIN")) / 2, "SST": F.coalesce("_sst", F.lit(SST_FILL_C)),
    }).select(STATION, F.lit(0).alias("_age"), *[F.col(c).cast("double").alias(c) for c in SEQUENCE])
    # Joined and not unioned: a union passes on the partitioning of its sides, which a broadcast join in one of them can
    # lose at run time, and Spark then groups the two sides of a station apart.
    step = F.struct("_age", *SEQUENCE)
    rows = (
        tail.groupBy(STATION).agg(F.collect_list(step).alias("_tail"))
        .join(today.select(STATION, F.array(step).alias("_today")), STATION, "full")
        .select(STATION, F.explode(F.concat(*[F.coalesce(c, F.array().cast(f"array<{STEP}>")) for c in ("_tail", "_today")])).alias("_s"))
        .select(STATION, "_s.*")
    )
    # At most ``length`` rows per station from here on.
    place = Window.partitionBy(STATION).orderBy(F.col("_age").desc())
    past, coming = place.rowsBetween(Window.unboundedPreceding, 0), place.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({
        c: F.coalesce(F.last(c, True).over(past), F.first(c, True).over(coming), F.lit(SST_FILL_C)) for c in SEQUENCE
    })
    step = F.struct((-F.col("_age")).alias("at"), *[F.col(c) for c in SEQUENCE])
    grouped = rows.groupBy(STATION).agg(F.array_sort(F.collect_list(step)).alias("_s"))
    bare = F.transform("_s", lambda s: F.struct(*[s[c].alias(c) for c in SEQUENCE]))
    pad = F.array_repeat(F.element_at(bare, 1), F.lit(length) - F.size(bare))
    return grouped.select(STATION, F.concat(pad, bare).alias("sequence"))


def latest_valid(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Last non-null value of each column per station, else its default."""
    return df.groupBy(STATION).agg(*[
        F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(DAY))), F.lit(v)).alias(c)
        for c, v in defaults.items()
    ])


def saturation_percentile(df: DataFrame, moisture: str = "SOIL_MOISTURE_VOL") -> DataFrame:
    """Percentile of root-zone moisture within the station's own record."""
    record = Window.partitionBy(STATION, F.col(moisture).isNull()).orderBy(moisture)
    return df.withColumn("SATURATION_PCTL", F.when(F.col(moisture).isNotNull(), F.percent_rank().over(record) * 100.0))
