"""Assembly, windows, thresholds, target and the full feature panel."""

from pyspark.sql import functions as F

from skyledger.operators import rolling as R
from skyledger.operators.cleaning import derive_tavg, fill_defaults
from skyledger.operators.target import drought_index, station_quantiles
from skyledger.plans.assemble import assemble
from skyledger.plans.features import feature_panel, hazard_panel, hazard_rates
from skyledger.registry.entries import query
from skyledger.registry.panel_sql import SOURCES, back, upto
from skyledger.registry.proxies import Tables, over
from skyledger.schema import FEATURES, STATION


def assembled(t: Tables):
    return assemble(
        t.obs(), stations=t.stations(), atmosphere=t.atmosphere(), soil=t.soil(), indices=t.indices(), sst=t.sst(),
        labels=t.labels(),
    )


def light_panel(t: Tables):
    """Observations with atmosphere and soil only, filled."""
    return fill_defaults(assemble(t.obs(), atmosphere=t.atmosphere(), soil=t.soil()))


LIGHT = """
    SELECT o.station, o.d, o.tmax, o.tmin, o.tavg, o.prcp, o.p,
           COALESCE(a.dewpoint_f, o.tavg * 9 / 5 + 32 - 15) AS dewpoint_f, COALESCE(a.windspeed_mph, 5) AS windspeed_mph,
           COALESCE(a.pressure_hpa, 1013.25::DOUBLE) AS pressure_hpa, COALESCE(a.humidity_pct, 50) AS humidity_pct,
           COALESCE(s.soil_moisture_vol, 0.2::DOUBLE) AS soil_moisture_vol, COALESCE(s.saturation_pct, 40) AS saturation_pct
    FROM day o
    LEFT JOIN atm a ON a.station = o.station AND a.d = o.d
    LEFT JOIN soil s ON s.station = o.station AND s.d = o.d"""
LIGHT_VIEWS = "obs day atm soil"


def light(statement: str, **extra: str) -> str:
    return over(LIGHT_VIEWS, statement, filled=LIGHT, **extra)


@query(
    "feature_panel",
    "station:s d:s " + " ".join(f"{c}:f" for c in FEATURES) + " risk_engineered:f risk:f event_label_available:i",
    over(
        SOURCES,
        "SELECT station, d, " + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in FEATURES)
        .replace("COALESCE(PRESSURE_DROP_3D, 0)", "GREATEST(PRESSURE_DROP_3D, 0)")
        + ", risk_engineered, risk, event_label_available FROM target WHERE risk IS NOT NULL",
        **upto("target"),
    ),
)
def _feature_panel(t):
    return feature_panel(assembled(t))


@query(
    "hazard_days", "station:s rows:n hazard_days:n hazard_rate:f next_day_rate:f worst_drought:f",
    over(
        SOURCES,
        """SELECT station, COUNT(*) AS rows, SUM(current_risk) AS hazard_days, AVG(current_risk) AS hazard_rate,
                  AVG(risk_engineered) AS next_day_rate, MAX(drought_idx) AS worst_drought
           FROM physics GROUP BY 1""",
        **upto("physics"),
    ),
)
def _hazard_days(t):
    return hazard_rates(assembled(t))


@query(
    "assemble_panel",
    "station:s d:s tmax:f tmin:f tavg:f prcp:f dewpoint_f:f windspeed_mph:f pressure_hpa:f humidity_pct:f"
    " soil_moisture_vol:f saturation_pct:f soil_moisture_observed:f climate_index_observed:f enso_nino34:f pdo_index:f"
    " nao_index:f sst:f latitude:f longitude:f elevation:f event_label:f event_type:s event_distance_km:f"
    " event_label_available:i",
    over(SOURCES, "SELECT * FROM assembled", **upto("assembled")),
)
def _assembled(t):
    return assembled(t)


@query(
    "rolling_rain_sums", "station:s d:s prcp_3d:f prcp_7d:f prcp_14d:f prcp_30d:f",
    over("day", "SELECT station, d, " + ", ".join(f"SUM(p) {back(n)} AS prcp_{n}d" for n in (3, 7, 14, 30)) + " FROM day"),
)
def _rain(t):
    return R.rolling_rain(t.obs())


@query(
    "rolling_peaks", "station:s d:s prcp_max_7d:f wind_max_7d:f saturation_max_7d:f",
    light(f"""SELECT station, d, MAX(p) {back(7)} AS prcp_max_7d, MAX(windspeed_mph) {back(7)} AS wind_max_7d,
                     MAX(saturation_pct) {back(7)} AS saturation_max_7d FROM filled"""),
)
def _peaks(t):
    return R.rolling_peaks(light_panel(t))


@query(
    "pressure_drop", "station:s d:s pressure_drop_3d:f",
    light(f"""SELECT station, d, GREATEST(MAX(pressure_hpa) {back(3)} - pressure_hpa, 0) AS pressure_drop_3d FROM filled"""),
)
def _drop(t):
    return R.pressure_drop(light_panel(t))


@query(
    "rolling_anomalies", "station:s d:s soil_moisture_anom_30d:f temp_anom_7d:f temp_anom:f prcp_anom:f",
    light(f"""SELECT station, d, soil_moisture_vol - AVG(soil_moisture_vol) {back(30)} AS soil_moisture_anom_30d,
                     tavg - AVG(tavg) {back(7)} AS temp_anom_7d, tavg - AVG(tavg) {back(30)} AS temp_anom,
                     p - AVG(p) {back(30)} AS prcp_anom FROM filled"""),
)
def _anomalies(t):
    return R.rolling_anomalies(light_panel(t))


DROUGHT = {
    "means": f"SELECT *, AVG(p) {back(30)} AS m FROM day",
    "dried": """SELECT *, CASE WHEN AVG(m) OVER (PARTITION BY station) - m < 0 THEN 0
                          ELSE AVG(m) OVER (PARTITION BY station) - m END AS drought_idx FROM means""",
}


@query("drought_index", "station:s d:s drought_idx:f", over("day", "SELECT station, d, drought_idx FROM dried", **DROUGHT))
def _drought(t):
    return drought_index(t.obs())


@query(
    "station_quantiles", "station:s t95:f t05:f rain90:f rain75:f",
    over("day", """SELECT station, QUANTILE_CONT(tavg, 0.95) AS t95, QUANTILE_CONT(tavg, 0.05) AS t05,
                          QUANTILE_CONT(prcp, 0.90) AS rain90, QUANTILE_CONT(prcp, 0.75) AS rain75 FROM day GROUP BY 1"""),
)
def _quantiles(t):
    return station_quantiles(derive_tavg(t.obs()), {
        "t95": ("TAVG", 0.95), "t05": ("TAVG", 0.05), "rain90": ("PRCP", 0.90), "rain75": ("PRCP", 0.75),
    })


@query(
    "extreme_flags", "station:s heat_days:n cold_days:n",
    over(
        "day",
        """SELECT station, SUM(CASE WHEN tavg > t95 THEN 1 ELSE 0 END) AS heat_days,
                  SUM(CASE WHEN tavg < t05 THEN 1 ELSE 0 END) AS cold_days FROM day JOIN q USING (station) GROUP BY 1""",
        q="SELECT station, QUANTILE_CONT(tavg, 0.95) AS t95, QUANTILE_CONT(tavg, 0.05) AS t05 FROM day GROUP BY 1",
    ),
)
def _extremes(t):
    from skyledger.functions.hazards import extreme_cold, extreme_heat
    from skyledger.operators.chunks import join_by_station

    panel = derive_tavg(t.obs())
    limits = station_quantiles(panel, {"t95": ("TAVG", 0.95), "t05": ("TAVG", 0.05)})
    return join_by_station(panel, limits).groupBy(STATION).agg(
        F.sum(extreme_heat(F.col("TAVG"), F.col("t95"))).alias("heat_days"),
        F.sum(extreme_cold(F.col("TAVG"), F.col("t05"))).alias("cold_days"),
    )


@query(
    "current_risk", "station:s d:s current_risk:f",
    light("SELECT station, d, current_risk FROM state",
          **{k: v for k, v in {
              "windowed": f"""SELECT *, AVG(p) {back(30)} AS m, prcp * (saturation_pct / 100) AS flood_risk_idx,
                              windspeed_mph * (1013.25::DOUBLE / CASE WHEN pressure_hpa < 900 THEN 900 ELSE pressure_hpa END)
                              AS wind_risk_idx, dewpoint_f AS dew FROM filled""",
              **{n: upto("state")[n] for n in ("dried", "limits", "state")}}.items()}),
)
def _current(t):
    from skyledger.operators.target import hazard_state, station_thresholds

    windows = R.panel_windows(light_panel(t).withColumn("SST", F.lit(18.0)))
    return hazard_state(windows, station_thresholds(windows))


@query(
    "next_day_target", "station:s d:s next_tmax:f",
    over("obs", "SELECT station, d, LEAD(tmax) OVER (PARTITION BY station ORDER BY d) AS next_tmax FROM obs"),
)
def _next_day(t):
    return R.next_day(t.obs(), "TMAX", "next_tmax")


@query(
    "hybrid_risk", "station:s d:s risk_engineered:f risk:f",
    over(SOURCES, "SELECT station, d, risk_engineered, risk FROM target WHERE risk IS NOT NULL", **upto("target")),
)
def _hybrid(t):
    from skyledger.operators.target import with_target

    return with_target(hazard_panel(assembled(t))).dropna(subset=["RISK"])
