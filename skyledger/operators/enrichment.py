"""Joining auxiliary series onto the panel. Every join keeps the panel's row count."""

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.columns import display_name, fahrenheit_to_celsius, row_mean
from skyledger.functions.hazards import ocean_basin
from skyledger.operators.chunks import CHUNK, attach, carry, chunk_bounds, join_by_station, with_chunk
from skyledger.operators.cleaning import soil_observed
from skyledger.schema import (
    ATMOSPHERE, BASINS, CATALOG_CLIMATE, CATALOG_FILL, CATALOG_REGION, DAY, INDICES, SOIL, SST_FILL_C, STATION,
)


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: several reports merge into the largest value of each measure.

    Measure by measure, the merge is a hash aggregation with map-side combine, and the join that
    follows reuses its partitioning.
    """
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in df.columns if c not in keys])


def per_day(df: DataFrame) -> DataFrame:
    """One row per calendar day, marked for broadcast.

    The bound is the date type itself: after the grouping there are at most as many rows as
    calendar days (about 11,000 for thirty years), whatever the size of the source.
    """
    return F.broadcast(one_per_key(df.filter(F.col(DAY).isNotNull()), [DAY]))


def station_catalog(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Two catalogs in one; the second wins per station as a whole row."""
    def upper(df):
        return one_per_key(df.withColumn("station_id", F.upper("station_id")), ["station_id"])

    columns = ["name", "region", "climate", "elevation", "lat", "lon", "ocean_basin"]
    first = upper(primary).select("station_id", *columns)
    second = upper(secondary).select("station_id", *columns, F.lit(True).alias("_wins"))
    second = second.withColumns({
        "region": F.coalesce("region", F.lit(CATALOG_REGION)),
        "climate": F.coalesce("climate", F.lit(CATALOG_CLIMATE)),
    })
    both = first.alias("a").join(second.alias("b"), "station_id", "full")
    return both.select(
        "station_id",
        *[F.when(F.col("b._wins"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns],
    )


def catalog_or_default(catalog: DataFrame, code: str = "SEATTLE") -> DataFrame:
    """The catalog, or the default row where it has no station."""
    fallback = default_catalog(catalog.sparkSession, code).select(catalog.columns)
    return catalog.unionByName(fallback.join(catalog.select("station_id").limit(1).toDF("_any"), F.lit(True), "left_anti"))


def default_catalog(spark, code: str = "SEATTLE") -> DataFrame:
    """The single row used when no catalog exists."""
    row = spark.range(1).select(F.lit(code).alias("station_id"))
    fills = [F.lit(v).alias(k) for k, v in CATALOG_FILL.items()]
    return row.select("station_id", display_name(F.col("station_id")).alias("name"), *fills)


def prefer_repaired(repaired: DataFrame, raw: DataFrame) -> DataFrame:
    """All rows of a station come from the repaired source if it has any there, else from the raw one."""
    fixed = repaired.select(STATION).distinct()
    return repaired.unionByName(join_by_station(raw, fixed, "left_anti"), allowMissingColumns=True)


def join_atmosphere(df: DataFrame, atmosphere: DataFrame) -> DataFrame:
    kept = [c for c in ATMOSPHERE if c in atmosphere.columns]
    right = one_per_key(atmosphere.select(STATION, DAY, *kept), [STATION, DAY])
    stale = ATMOSPHERE + [c.lower() for c in ATMOSPHERE]
    return df.drop(*stale).join(right, [STATION, DAY], "left")


def join_soil(df: DataFrame, soil: DataFrame) -> DataFrame:
    """Soil measures and their freshness flag: null on unmatched days, 0 for stations without soil data."""
    kept = [c for c in SOIL if c in soil.columns]
    right = one_per_key(soil_observed(soil.select(STATION, DAY, *kept)), [STATION, DAY])
    base = with_chunk(df.drop(*SOIL, "SOIL_MOISTURE_OBSERVED"))
    reach = base.groupBy(STATION).agg(*chunk_bounds())
    known = soil.select(STATION).distinct().withColumn("_has_soil", F.lit(True))
    joined = attach(base, reach.join(known, STATION, "left")).join(right, [STATION, DAY], "left")
    flag = F.when(F.col("_has_soil"), F.col("SOIL_MOISTURE_OBSERVED")).otherwise(F.lit(0.0))
    return joined.withColumn("SOIL_MOISTURE_OBSERVED", flag).drop("_has_soil", CHUNK)


def join_indices(df: DataFrame, indices: DataFrame, fill: bool = True) -> DataFrame:
    """Climate indices by day, with a freshness flag taken before the gaps are carried over."""
    names = [c for c in INDICES if c in indices.columns]
    right = per_day(indices.select(DAY, *names))
    joined = df.drop(*names).join(right, DAY, "left")
    seen = F.coalesce(*[F.col(c) for c in names]).isNotNull()
    joined = joined.withColumn("CLIMATE_INDEX_OBSERVED", F.when(seen, 1.0).otherwise(0.0))
    return fill_indices(joined, names) if fill else joined


def fill_indices(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Carry each index forward, then backward, along the station's rows."""
    return carry(with_chunk(df), names or INDICES).drop(CHUNK)


def basin_series(sst: DataFrame) -> DataFrame:
    """(Date, basin, celsius) for each basin column, plus basin ``mean`` across them."""
    known = [c for c in BASINS if c in sst.columns]
    wide = one_per_key(sst.select(DAY, *known), [DAY]).withColumn("mean", row_mean(known))
    long = wide.unpivot(DAY, [*known, "mean"], "basin", "_f")
    return long.select(DAY, "basin", fahrenheit_to_celsius(F.col("_f")).alias("_sst"))


def station_basins(df: DataFrame) -> DataFrame:
    """Basin per station from its name or its median coordinates, with the station's year bounds."""
    base = with_chunk(df)
    reach = base.groupBy(STATION).agg(*chunk_bounds())
    if not {"LATITUDE", "LONGITUDE"} <= set(df.columns):
        nowhere = F.lit(None).cast("double")
        placed = reach.withColumn("basin", ocean_basin(F.col(STATION), nowhere, nowhere))
    else:
        middle = [F.percentile(c, 0.5).alias(n) for n, c in (("_lat", "LATITUDE"), ("_lon", "LONGITUDE"))]
        placed = base.groupBy(STATION).agg(*chunk_bounds(), *middle).withColumn(
            "basin", ocean_basin(F.col(STATION), F.col("_lat"), F.col("_lon"))
        ).drop("_lat", "_lon")
    return placed.withColumn("basin", F.coalesce("basin", F.lit("mean")))


def join_sst_daily(df: DataFrame, sst: DataFrame, fill: bool = True) -> DataFrame:
    """Sea-surface temperature (Celsius) of each station's basin.

    Days without a value take the nearest earlier one, else the nearest later one, else the
    basin's mean, else a constant.
    """
    series = basin_series(sst)
    averages = series.groupBy("basin").agg(F.avg("_sst").alias("_sst_mean"))
    # At most four basins per calendar day: bounded by the date type like ``per_day``.
    right = F.broadcast(series.join(F.broadcast(averages), "basin"))
    base = with_chunk(df.drop("SST"))
    placed = attach(base, station_basins(df))
    joined = placed.join(right.drop("_sst_mean"), [DAY, "basin"], "left")
    joined = joined.join(F.broadcast(averages), "basin", "left").drop("basin")
    filled = carry(joined, ["_sst"]) if fill else joined
    value = F.coalesce("_sst", "_sst_mean", F.lit(SST_FILL_C)) if fill else F.col("_sst")
    return filled.withColumn("SST", value).drop("_sst", "_sst_mean", CHUNK)


def join_sst_monthly(df: DataFrame, monthly: DataFrame) -> DataFrame:
    """Fallback grain, for an archive that has no daily series."""
    months = monthly.select(
        F.col("Year").cast("int").alias("_year"), F.col("Month").cast("int").alias("_month"),
        F.col("SST_Mean_Celsius").alias("_sst"),
    )
    # One row per month of the calendar, so bounded like ``per_day``.
    right = F.broadcast(one_per_key(months, ["_year", "_month"]))
    base = with_chunk(df.drop("SST")).withColumns({"_year": F.year(DAY), "_month": F.month(DAY)})
    joined = carry(base.join(right, ["_year", "_month"], "left"), ["_sst"])
    mean = months.agg(F.avg("_sst").alias("_sst")).scalar()
    return joined.withColumn("SST", F.coalesce(F.col("_sst"), mean, F.lit(SST_FILL_C))).drop(
        "_sst", "_year", "_month", CHUNK
    )


def join_sst(df: DataFrame, daily: DataFrame | None = None, monthly: DataFrame | None = None) -> DataFrame:
    """Daily series if there is one, else monthly, else the constant."""
    if daily is not None:
        return join_sst_daily(df, daily)
    if monthly is not None:
        return join_sst_monthly(df, monthly)
    return df.withColumn("SST", F.lit(SST_FILL_C))


LABEL_COLUMNS = ["EVENT_LABEL", "EVENT_TYPE", "EVENT_DISTANCE_KM"]


def clean_labels(raw: DataFrame) -> DataFrame | None:
    """Typed event labels, or None where the source lacks a required column."""
    if not {"date", "NOAA_STATION", "EVENT_LABEL"} <= set(raw.columns):
        return None
    optional = {"EVENT_TYPE": "string", "EVENT_DISTANCE_KM": "double"}
    return raw.select(
        F.to_date(F.col("date").try_cast("timestamp")).alias(DAY),
        F.upper(F.col("NOAA_STATION").cast("string")).alias(STATION),
        F.coalesce(F.col("EVENT_LABEL").try_cast("double").cast("int"), F.lit(0)).alias("EVENT_LABEL"),
        *[
            (F.col(c).try_cast(k) if c in raw.columns else F.lit(None).cast(k)).alias(c)
            for c, k in optional.items()
        ],
    ).dropna(subset=[DAY])


def dedup_labels(labels: DataFrame) -> DataFrame:
    """One row per station-day: largest label, distinct types in order, nearest distance."""
    return labels.groupBy(DAY, STATION).agg(
        F.max("EVENT_LABEL").alias("EVENT_LABEL"),
        F.array_join(F.array_sort(F.collect_set("EVENT_TYPE")), "; ").alias("EVENT_TYPE"),
        F.min("EVENT_DISTANCE_KM").alias("EVENT_DISTANCE_KM"),
    )


def join_event_labels(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Attach labels by station-day; unmatched rows keep null label and empty type."""
    base = df.drop(*LABEL_COLUMNS, "EVENT_LABEL_AVAILABLE")
    if labels is None:
        return base.withColumns({
            "EVENT_LABEL": F.lit(None).cast("double"),
            "EVENT_TYPE": F.lit(""),
            "EVENT_DISTANCE_KM": F.lit(None).cast("double"),
            "EVENT_LABEL_AVAILABLE": F.lit(0),
        })
    right = dedup_labels(labels).withColumn("_hit", F.lit(1))
    joined = base.join(right, [DAY, STATION], "left")
    return joined.withColumns({
        "EVENT_LABEL": F.col("EVENT_LABEL").cast("double"),
        "EVENT_TYPE": F.coalesce("EVENT_TYPE", F.lit("")),
        "EVENT_LABEL_AVAILABLE": F.coalesce("_hit", F.lit(0)),
    }).drop("_hit")


def label_period(labels: DataFrame):
    """First and last day of all labels, as one column from one scan."""
    return labels.agg(F.struct(F.min(DAY).alias("first"), F.max(DAY).alias("last"))).scalar()


def label_coverage(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of a labelled station inside the labels' overall period count as available, label 0 if none."""
    period = label_period(labels)
    covered = labels.select(STATION).distinct().withColumn("_covered", F.lit(True))
    base = with_chunk(df)
    reach = base.groupBy(STATION).agg(*chunk_bounds()).join(covered, STATION, "left")
    placed = attach(base, reach)
    inside = F.coalesce(F.col("_covered") & F.col(DAY).between(period["first"], period["last"]), F.lit(False))
    return placed.withColumns({
        "EVENT_LABEL": F.when(inside, F.coalesce("EVENT_LABEL", F.lit(0.0))).otherwise(F.col("EVENT_LABEL")),
        "EVENT_LABEL_AVAILABLE": F.when(inside, F.lit(1)).otherwise(F.col("EVENT_LABEL_AVAILABLE")),
    }).drop("_covered", CHUNK)


def align_modalities(df: DataFrame, atmosphere: DataFrame, indices: DataFrame, sst: DataFrame, basin="sst_pacific_f"):
    """Panel rows with atmosphere, indices and one basin's temperature, unfilled, for correlation."""
    ocean = per_day(sst.select(DAY, fahrenheit_to_celsius(F.col(basin)).alias("sst_c")))
    names = [c for c in INDICES if c in indices.columns]
    joined = join_atmosphere(df, atmosphere).join(per_day(indices.select(DAY, *names)), DAY, "left")
    return joined.join(ocean, DAY, "left")


def align_fusion_inputs(sequence_scores: DataFrame, tabular_scores: DataFrame) -> DataFrame:
    """Both model outputs of the same station and day."""
    return sequence_scores.join(tabular_scores, [STATION, DAY])


def station_quality(df: DataFrame, health: DataFrame) -> DataFrame:
    """Readiness and completeness per catalog station; a station without audit counts as ready."""
    right = health.select("station_id", "training_ready", "core_completeness_pct")
    return df.join(one_per_key(right, ["station_id"]), "station_id", "left").withColumns({
        "training_ready": F.coalesce("training_ready", F.lit(True)),
        "core_completeness_pct": F.coalesce("core_completeness_pct", F.lit(0.0)),
    })
