"""Sources-side cleaning, filters, fills and data-quality queries."""

from pyspark.sql import functions as F

from skyledger.functions.columns import row_mean
from skyledger.operators import cleaning as C
from skyledger.operators import climatology as K
from skyledger.operators.enrichment import prefer_repaired, station_catalog
from skyledger.operators.picks import append_observation, pool_stations, since
from skyledger.registry.entries import query
from skyledger.registry.features import assembled, light, light_panel
from skyledger.registry.panel_sql import SOURCES, upto
from skyledger.registry.proxies import over
from skyledger.schema import BASINS, DAY, REQUIRED, STATION

OBS = "station:s d:s tmax:f tmin:f prcp:f"


@query(
    "date_range", OBS,
    over("obs", "SELECT * FROM obs WHERE d BETWEEN DATE '1997-03-01' AND DATE '1998-02-15'"),
)
def _range(t):
    return C.date_range(t.obs(), "1997-03-01", "1998-02-15")


@query(
    "latest_window_fallback", OBS + " source:s",
    over(
        "obs",
        """SELECT o.*, CASE WHEN hits = 0 THEN 'NOAA Daily Station Archive (latest available window)'
                           ELSE 'NOAA Daily Station Archive' END AS source
           FROM obs o JOIN reach USING (station)
           WHERE CASE WHEN hits = 0 THEN d >= latest - 4 ELSE d BETWEEN DATE '2001-10-08' AND DATE '2001-10-12' END""",
        reach="""SELECT station, MAX(d) AS latest,
                        COUNT(CASE WHEN d BETWEEN DATE '2001-10-08' AND DATE '2001-10-12' THEN 1 END) AS hits
                 FROM obs GROUP BY 1""",
    ),
)
def _fallback(t):
    return C.latest_window_fallback(t.obs(), "2001-10-08", "2001-10-12")


@query(
    "normalise_names", "station:s d:s DEWPOINT_F:f WINDSPEED_MPH:f PRESSURE_HPA:f HUMIDITY_PCT:f",
    over("atm", """SELECT station, d, dewpoint_f AS DEWPOINT_F, windspeed_mph AS WINDSPEED_MPH, pressure_hpa AS PRESSURE_HPA,
                          humidity_pct AS HUMIDITY_PCT FROM atm"""),
)
def _names(t):
    lower = t.atmosphere()
    return C.normalise_names(lower.toDF(*[c if c in (STATION, DAY) else c.lower() for c in lower.columns]))


@query("drop_source_columns", OBS, over("obs", "SELECT * FROM obs"))
def _drop(t):
    raw = t.obs().withColumns({"data_source": F.lit("archive"), "record_max_temp": F.lit(1.0), "average_min_temp": F.lit(2.0)})
    return C.drop_source_columns(raw)


@query(
    "parse_dates", "station:s d:s rec_max_yr:n",
    over("rawlab", """SELECT UPPER(noaa_station) AS station, TRY_CAST(date AS DATE) AS d,
                             YEAR(TRY_CAST(date AS DATE)) - 5 AS rec_max_yr FROM rawlab"""),
)
def _dates(t):
    raw = t.raw_labels().select(F.upper("NOAA_STATION").alias(STATION), "date")
    parsed = C.parse_dates(raw).withColumn("record_max_temp_year", F.year(DAY) - 5)
    return C.copy_record_years(parsed)


@query(
    "coerce_numeric", "event_label:f event_distance_km:f rows:n",
    over("rawlab", """SELECT TRY_CAST(event_label AS DOUBLE) AS event_label,
                             TRY_CAST(event_distance_km AS DOUBLE) AS event_distance_km, COUNT(*) AS rows
                      FROM rawlab GROUP BY 1, 2"""),
)
def _coerce(t):
    typed = C.coerce_numeric(t.raw_labels(), ["EVENT_LABEL", "EVENT_DISTANCE_KM"])
    return typed.groupBy("EVENT_LABEL", "EVENT_DISTANCE_KM").agg(F.count(F.lit(1)).alias("rows"))


FILLED = "dewpoint_f:f windspeed_mph:f pressure_hpa:f humidity_pct:f soil_moisture_vol:f saturation_pct:f"


@query("fill_defaults", f"station:s d:s {FILLED}", light("SELECT * FROM filled"))
def _fill(t):
    return light_panel(t)


@query("derive_tavg", "station:s d:s tavg:f", over("day", "SELECT station, d, tavg FROM day"))
def _tavg(t):
    return C.derive_tavg(t.obs())


@query(
    "unit_conversions", "station:s d:s dewpoint_c:f windspeed_kmh:f windspeed_back_mph:f",
    over("atm", """SELECT station, d, (dewpoint_f - 32) * 5 / 9 AS dewpoint_c, windspeed_mph * 1.60934::DOUBLE AS windspeed_kmh,
                          windspeed_mph AS windspeed_back_mph FROM atm"""),
)
def _units(t):
    return C.units(t.atmosphere())


@query(
    "provenance", "station:s d:s source:s data_end_date:s city_name:s",
    over("obs stations", """SELECT o.station, o.d, 'NOAA Daily Station Archive' AS source,
                                   strftime(MAX(o.d) OVER (PARTITION BY o.station), '%Y-%m-%d') AS data_end_date,
                                   COALESCE(s.name, o.station) AS city_name
                            FROM obs o LEFT JOIN stations s ON s.station = o.station"""),
)
def _provenance(t):
    return C.provenance(t.obs(), t.stations())


@query(
    "soil_observed", "station:s d:s soil_moisture_observed:f",
    over("soil", """SELECT station, d, CASE WHEN COALESCE(soil_moisture_vol, saturation_pct) IS NOT NULL THEN 1 ELSE 0 END
                           AS soil_moisture_observed FROM soil"""),
)
def _soil(t):
    return C.soil_observed(t.soil())


HEALTH = {
    "audit": """SELECT station AS station_id, COUNT(*) AS rows, COUNT(CASE WHEN d IS NULL OR tmax < tmin THEN 1 END) AS errors,
                       100 * (AVG(CASE WHEN tmax IS NULL THEN 0 ELSE 1 END) + AVG(CASE WHEN tmin IS NULL THEN 0 ELSE 1 END)
                              + AVG(CASE WHEN prcp IS NULL THEN 0 ELSE 1 END)) / 3 AS core_completeness_pct
                FROM obs GROUP BY 1""",
    "health": "SELECT *, core_completeness_pct >= 97 AND errors = 0 AS training_ready FROM audit",
}


def health(t):
    return C.audit_health(t.obs(), cutoff_pct=97.0)


@query(
    "audit_health", "station_id:s rows:n errors:n core_completeness_pct:f training_ready:i",
    over("obs", "SELECT * FROM health", **HEALTH),
)
def _audit(t):
    return health(t)


@query(
    "audit_totals", "unique_noaa_stations:n station_errors:n stations_training_ready:n",
    over("obs", """SELECT COUNT(*) AS unique_noaa_stations, COUNT(CASE WHEN errors > 0 THEN 1 END) AS station_errors,
                          COUNT(CASE WHEN training_ready THEN 1 END) AS stations_training_ready FROM health""", **HEALTH),
)
def _totals(t):
    return C.health_totals(health(t))


@query(
    "ready_stations", "station_id:s rows:n",
    over("obs", "SELECT station_id, rows FROM health WHERE training_ready AND station_id LIKE 'USW%'", **HEALTH),
)
def _ready(t):
    return C.ready_stations(health(t))


@query(
    "final_zero_fill", "station:s d:s pressure_hpa:f sst:f risk:f",
    over("obs atm", """SELECT o.station, o.d, COALESCE(a.pressure_hpa, 0) AS pressure_hpa, COALESCE(o.tmin, 0) AS sst,
                              o.tmax AS risk FROM obs o LEFT JOIN atm a ON a.station = o.station AND a.d = o.d
                       WHERE o.tmax IS NOT NULL"""),
)
def _zero(t):
    joined = t.obs().join(t.atmosphere(), [STATION, DAY], "left")
    return C.final_zero_fill(joined.withColumns({"SST": F.col("TMIN"), "RISK": F.col("TMAX")}))


@query(
    "history_shortfall", "station:s rows:n",
    over("obs", "SELECT station, COUNT(*) AS rows FROM obs GROUP BY 1 HAVING COUNT(*) < 530"),
)
def _shortfall(t):
    return C.history_shortfall(C.require_history(t.obs(), 100), 530)


@query("preview", OBS, over("obs", "SELECT * FROM obs ORDER BY d, station LIMIT 5"))
def _preview(t):
    return C.preview(t.obs(), 5)


@query("dimensions", "rows:n columns:i", over("obs", "SELECT COUNT(*) AS rows, 5 AS columns FROM obs"))
def _dimensions(t):
    return C.dimensions(t.obs())


@query(
    "missing_stations", "station:s",
    over("obs chips", "SELECT DISTINCT station FROM chips WHERE station NOT IN (SELECT station FROM obs)"),
)
def _missing(t):
    return C.missing_stations(t.chips(), t.obs())


# Sources and catalogs -----------------------------------------------------------------------


@query(
    "station_catalog", "station_id:s name:s region:s climate:s elevation:f lat:f lon:f ocean_basin:s",
    over(
        "stations",
        """SELECT COALESCE(b.station, a.station) AS station_id, CASE WHEN w THEN b.name ELSE a.name END AS name,
                  CASE WHEN w THEN COALESCE(b.region, 'NOAA Daily Station Network') ELSE a.region END AS region,
                  CASE WHEN w THEN COALESCE(b.climate, 'Station observations') ELSE a.climate END AS climate,
                  CASE WHEN w THEN b.elevation ELSE a.elevation END AS elevation,
                  CASE WHEN w THEN b.lat ELSE a.lat END AS lat, CASE WHEN w THEN b.lon ELSE a.lon END AS lon,
                  CASE WHEN w THEN b.ocean_basin ELSE a.ocean_basin END AS ocean_basin
           FROM a FULL JOIN b ON a.station = b.station""",
        a="SELECT * FROM stations WHERE elevation >= 500",
        b="SELECT * REPLACE (lat + 1 AS lat), TRUE AS w FROM stations WHERE elevation < 900",
    ),
)
def _catalog(t):
    stations = t.stations()
    primary = stations.filter("elevation >= 500").withColumn("station_id", F.lower("station_id"))
    return station_catalog(primary, stations.filter("elevation < 900").withColumn("lat", F.col("lat") + 1))


@query(
    "prefer_repaired", "station:s d:s dewpoint_f:f humidity_pct:f",
    over(
        "atm",
        """SELECT station, d, dewpoint_f, humidity_pct FROM fixed UNION ALL
           SELECT station, d, dewpoint_f, humidity_pct FROM atm WHERE station NOT IN (SELECT station FROM fixed)""",
        fixed="SELECT * REPLACE (dewpoint_f + 1 AS dewpoint_f) FROM atm WHERE humidity_pct > 99",
    ),
)
def _repaired(t):
    fixed = t.atmosphere().filter("HUMIDITY_PCT > 99").withColumn("DEWPOINT_F", F.col("DEWPOINT_F") + 1)
    return prefer_repaired(fixed, t.atmosphere())


@query(
    "event_labels_typed", "station:s d:s event_label:i event_type:s event_distance_km:f",
    over("lab", "SELECT * FROM lab"),
)
def _labels(t):
    return t.labels()


@query(
    "prepare_daily", OBS,
    over("obs", "SELECT station, d, (tmax - 32) * 5 / 9 AS tmax, (tmin - 32) * 5 / 9 AS tmin, prcp * 25.4::DOUBLE AS prcp FROM obs"),
)
def _prepare(t):
    from skyledger.sources.writers import prepare_daily

    return prepare_daily(export(t))[0]


def export(t):
    """A daily export: text values, two rows for some station-days."""
    places = t.stations()
    rows = t.obs().join(places, F.col(STATION) == F.col("station_id"), "left").select(
        F.lower(STATION).alias("STATION"), F.col("name").alias("NAME"), F.col("lat").cast("string").alias("LATITUDE"),
        F.col("lon").cast("string").alias("LONGITUDE"), F.col("elevation").cast("string").alias("ELEVATION"),
        F.date_format(DAY, "yyyy-MM-dd").alias("DATE"), *[F.col(c).cast("string").alias(c) for c in ("TMAX", "TMIN", "PRCP")],
    )
    return rows.unionByName(rows.filter(F.col("TMAX").try_cast("double") > 30))


@query(
    "prepared_catalog", "station_id:s name:s lat:f lon:f elevation:f",
    over("obs stations", """SELECT station AS station_id, name, lat, lon, elevation FROM stations
                            WHERE station IN (SELECT station FROM obs)"""),
)
def _prepared_catalog(t):
    from skyledger.sources.writers import prepare_daily

    return prepare_daily(export(t))[1]


# Checks, pooling ----------------------------------------------------------------------------


@query(
    "distinct_stations", "stations:n",
    over("obs", "SELECT COUNT(DISTINCT station) AS stations FROM obs WHERE station LIKE 'USW%'"),
)
def _distinct(t):
    return K.distinct_stations(t.obs())


@query(
    "coverage_check", "series:s first:s last:s covers:i",
    over("idx sst", """SELECT 'indices' AS series, MIN(d) AS first, MAX(d) AS last,
                              MIN(d) <= DATE '1995-01-01' AND MAX(d) >= DATE '2001-07-15' AS covers FROM idx
                       UNION ALL SELECT 'sst', MIN(d), MAX(d), MIN(d) <= DATE '1995-01-01' AND MAX(d) >= DATE '2001-07-21' FROM sst"""),
)
def _coverage(t):
    one = K.coverage_check(t.indices(), "1995-01-01", "2001-07-15").withColumn("series", F.lit("indices"))
    return one.unionByName(K.coverage_check(t.sst(), "1995-01-01", "2001-07-21").withColumn("series", F.lit("sst")))


@query(
    "completeness_check", "name:s nulls:n",
    over(
        SOURCES,
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, COUNT(CASE WHEN {c} IS NULL THEN 1 END) AS nulls FROM assembled" for c in REQUIRED
        ),
        **upto("assembled"),
    ),
)
def _completeness(t):
    return K.completeness_check(assembled(t), REQUIRED)


@query(
    "row_mean", "d:s mean_f:f",
    over("sst", """SELECT d, (COALESCE(sst_pacific_f, 0) + COALESCE(sst_atlantic_f, 0) + COALESCE(sst_gulf_f, 0))
                             / (CASE WHEN sst_atlantic_f IS NULL THEN 2 ELSE 3 END) AS mean_f FROM sst"""),
)
def _row_mean(t):
    return t.sst().withColumn("mean_f", row_mean(BASINS))


@query(
    "pool_stations", "station:s d:s tmax:f humidity_pct:f",
    over("obs atm", """SELECT station, d, tmax, NULL AS humidity_pct FROM obs UNION ALL
                       SELECT station, d, NULL, humidity_pct FROM atm"""),
)
def _pool(t):
    return pool_stations([t.obs(), t.atmosphere()])


@query("since_date", OBS, over("obs", "SELECT * FROM obs WHERE d >= DATE '2000-01-01'"))
def _since(t):
    return since(t.obs(), "2000-01-01")


@query(
    "append_observation", OBS,
    over("obs", """SELECT station, d, tmax, tmin, prcp FROM obs UNION ALL
                   SELECT station, MAX(d) + 1, MAX(tmax), MIN(tmin), 0 FROM obs GROUP BY 1"""),
)
def _append(t):
    today = t.obs().groupBy(STATION).agg(
        F.date_add(F.max(DAY), 1).alias(DAY), F.max("TMAX").alias("TMAX"), F.min("TMIN").alias("TMIN"), F.lit(0.0).alias("PRCP")
    )
    return append_observation(t.obs(), today)
