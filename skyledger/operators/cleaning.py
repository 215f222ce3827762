"""Projections, filters and fills on the station-day panel."""

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.columns import column_or_null, fahrenheit_to_celsius, kmh_to_mph, mph_to_kmh, numeric
from skyledger.operators.chunks import CHUNK, attach, chunk_bounds, join_by_station, with_chunk
from skyledger.schema import (
    ALIASES, ARCHIVE_SOURCE, CONSTANT_FILLS, DAY, DEWPOINT_GAP_F, FEATURES, LATEST_SUFFIX, RAW_COLUMNS,
    RECORD_YEARS, SOIL, STATION,
)


class MissingStation(LookupError):
    """A requested station has no prepared data."""


class ShortHistory(ValueError):
    """Too few rows to train on."""


def date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the closed interval; ordering is left to the sink."""
    return df.filter(F.col(DAY).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def latest_window_fallback(df: DataFrame, start: str, end: str) -> DataFrame:
    """The interval per station or, where a station has no row in it, its latest equally long window.

    ``Source`` tells the two apart.
    """
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    inside = F.col(DAY).between(lo, hi)
    days = F.greatest(F.lit(1), F.date_diff(hi, lo))
    chunked = with_chunk(df)
    reach = chunked.groupBy(STATION).agg(
        F.max(DAY).alias("_latest"), F.count_if(inside).alias("_hits"), *chunk_bounds()
    )
    placed = attach(chunked, reach)
    archived = F.col("_hits") == 0
    kept = F.when(archived, F.col(DAY) >= F.date_sub("_latest", days)).otherwise(inside)
    source = F.when(archived, F.lit(ARCHIVE_SOURCE + LATEST_SUFFIX)).otherwise(F.lit(ARCHIVE_SOURCE))
    return placed.filter(kept).withColumn("Source", source).drop("_latest", "_hits", CHUNK)


def normalise_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in ALIASES.items() if new not in df.columns})


def drop_source_columns(df: DataFrame) -> DataFrame:
    # Column names are matched case-sensitively: ``date`` goes, ``Date`` stays.
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in RAW_COLUMNS])


def copy_record_years(df: DataFrame) -> DataFrame:
    return df.withColumns({new: F.col(old) for old, new in RECORD_YEARS.items() if old in df.columns})


def parse_dates(df: DataFrame, raw: str = "date") -> DataFrame:
    """Adds the day key; the raw text column is renamed so that names differ by more than case."""
    parsed = F.to_date(F.col(raw).try_cast("timestamp"))
    if raw.lower() == DAY.lower():
        return df.withColumn(raw, parsed).withColumnRenamed(raw, DAY)
    return df.withColumn(DAY, parsed)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: numeric(df, c) for c in columns})


def derive_tavg(df: DataFrame) -> DataFrame:
    """Midpoint of TMAX and TMIN, only where the column is absent altogether."""
    return df if "TAVG" in df.columns else df.withColumn("TAVG", (F.col("TMAX") + F.col("TMIN")) / 2)


def fill_defaults(df: DataFrame) -> DataFrame:
    dew = F.col("TAVG") * 9 / 5 + 32 - DEWPOINT_GAP_F
    fills = {"DEWPOINT_F": F.coalesce(column_or_null(df, "DEWPOINT_F"), dew)}
    for name, value in CONSTANT_FILLS.items():
        known = numeric(df, name) if name in df.columns else F.lit(None).cast("double")
        fills[name] = F.coalesce(known, F.lit(value))
    return df.withColumns(fills)


def units(df: DataFrame) -> DataFrame:
    """Dew point in Celsius and wind in km/h next to the source units, and wind back in mph."""
    kmh = mph_to_kmh(F.col("WINDSPEED_MPH"))
    return df.withColumns({
        "DEWPOINT_C": fahrenheit_to_celsius(F.col("DEWPOINT_F")),
        "WINDSPEED_KMH": kmh,
        "WINDSPEED_BACK_MPH": kmh_to_mph(kmh),
    })


def provenance(df: DataFrame, catalog: DataFrame, source: str = ARCHIVE_SOURCE) -> DataFrame:
    """Source, last archived day and station name. Apply before any date filter."""
    chunked = with_chunk(df)
    facts = chunked.groupBy(STATION).agg(F.max(DAY).alias("_end"), *chunk_bounds())
    names = catalog.select(F.col("station_id").alias(STATION), F.col("name").alias("_name"))
    facts = facts.join(names, STATION, "left")
    return (
        attach(chunked, facts)
        .withColumns({
            "Source": F.lit(source),
            "Data_End_Date": F.date_format("_end", "yyyy-MM-dd"),
            "City_Name": F.coalesce("_name", F.col(STATION)),
        })
        .drop("_end", "_name", CHUNK)
    )


def soil_observed(soil: DataFrame) -> DataFrame:
    """1 where the soil row holds any measure; evaluated on the soil side, before the join."""
    known = F.coalesce(*[column_or_null(soil, c) for c in SOIL]).isNotNull()
    return soil.withColumn("SOIL_MOISTURE_OBSERVED", F.when(known, 1.0).otherwise(0.0))


def ready_stations(health: DataFrame, prefix: str = "USW") -> DataFrame:
    return health.filter(F.col("station_id").startswith(prefix) & F.coalesce("training_ready", F.lit(False)))


def final_zero_fill(df: DataFrame, features=FEATURES) -> DataFrame:
    """Zero for missing ``features``; rows without a target go."""
    return df.fillna(0, subset=[c for c in features if c in df.columns]).dropna(subset=["RISK"])


def history_shortfall(df: DataFrame, minimum: int) -> DataFrame:
    """Stations with fewer rows than the minimum."""
    return df.groupBy(STATION).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") < minimum)


def require_history(df: DataFrame, minimum: int = 100) -> DataFrame:
    """Raise unless the frame as a whole holds enough rows."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise ShortHistory(f"{found} rows, at least {minimum} are needed")
    return df


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows in (day, station) order."""
    return df.orderBy(DAY, STATION).limit(n)


def dimensions(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def missing_stations(requested: DataFrame, panel: DataFrame) -> DataFrame:
    """Requested ids without a single panel row."""
    present = panel.select(STATION).distinct()
    return requested.select(F.upper(STATION).alias(STATION)).distinct().join(present, STATION, "left_anti")


def require_stations(panel: DataFrame, requested: DataFrame) -> DataFrame:
    """The panel of the requested stations; never fabricates data for an absent one."""
    absent, first = missing_stations(requested, panel).agg(F.count(F.lit(1)), F.min(STATION)).first()
    if absent:
        raise MissingStation(f"no prepared data for {absent} stations, the first is {first}; missing_stations has them all")
    wanted = requested.select(F.upper(STATION).alias(STATION)).distinct()
    return join_by_station(panel, wanted, "left_semi")


CORE = ["TMAX", "TMIN", "PRCP", "DEWPOINT_F", "WINDSPEED_MPH", "PRESSURE_HPA", "HUMIDITY_PCT"]


def audit_health(df: DataFrame, core: list[str] | None = None, cutoff_pct: float = 80.0) -> DataFrame:
    """One row per station: rows, errors (impossible or missing keys), completeness, readiness."""
    core = core or [c for c in CORE if c in df.columns]
    share = [F.avg(F.col(c).isNotNull().cast("double")) for c in core]
    total = share[0]
    for s in share[1:]:
        total = total + s
    wrong = F.col(DAY).isNull() | F.coalesce(F.col("TMAX") < F.col("TMIN"), F.lit(False))
    audited = df.groupBy(F.col(STATION).alias("station_id")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(wrong).alias("errors"),
        (total * 100.0 / len(core)).alias("core_completeness_pct"),
    )
    ready = (F.col("core_completeness_pct") >= cutoff_pct) & (F.col("errors") == 0)
    return audited.withColumn("training_ready", ready)


def health_totals(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("unique_noaa_stations"),
        F.count_if(F.col("errors") > 0).alias("station_errors"),
        F.count_if("training_ready").alias("stations_training_ready"),
    )
