"""Climatology tables."""

from pyspark.sql import functions as F

from skyledger.operators import climatology as K
from skyledger.operators.cleaning import derive_tavg
from skyledger.operators.enrichment import align_modalities
from skyledger.operators.picks import recent_years
from skyledger.registry.entries import query
from skyledger.registry.proxies import over


def panel(t):
    return derive_tavg(t.obs())


@query(
    "monthly_summary",
    "station:s month:s avg_max_temp:f avg_min_temp:f peak_temp:f total_rainfall:f rainy_days:n",
    over("obs", """SELECT station, strftime(d, '%Y-%m') AS month, ROUND(AVG(tmax), 1) AS avg_max_temp,
                          ROUND(AVG(tmin), 1) AS avg_min_temp, ROUND(MAX(tmax), 1) AS peak_temp,
                          ROUND(COALESCE(SUM(prcp), 0), 1) AS total_rainfall,
                          COUNT(CASE WHEN prcp > 0.1 THEN 1 END) AS rainy_days FROM obs GROUP BY 1, 2"""),
)
def _monthly(t):
    return K.monthly_summary(t.obs())


@query(
    "window_kpis",
    "station:s avg_temp:f peak_temp:f min_temp:f total_rain:f max_daily_rain:f rainy_days:n rainy_pct:f",
    over("obs", """SELECT station, (AVG(tmax) + AVG(tmin)) / 2 AS avg_temp, MAX(tmax) AS peak_temp, MIN(tmin) AS min_temp,
                          COALESCE(SUM(prcp), 0) AS total_rain, MAX(prcp) AS max_daily_rain,
                          COUNT(CASE WHEN prcp > 0.1 THEN 1 END) AS rainy_days,
                          100 * CAST(COUNT(CASE WHEN prcp > 0.1 THEN 1 END) AS DOUBLE) / COUNT(*) AS rainy_pct
                   FROM obs GROUP BY 1"""),
)
def _kpis(t):
    return K.window_kpis(t.obs())


#: All days from 1998 on move a year and a day on, so that a calendar year is empty.
GAPPED = "SELECT * REPLACE (CASE WHEN d >= DATE '1998-01-01' THEN d + 366 ELSE d END AS d) FROM fx_day"
ANNUAL = {
    "y": f"SELECT station, YEAR(d) AS year, AVG(tavg) AS tavg, SUM(prcp) AS prcp FROM ({GAPPED}) GROUP BY 1, 2",
    "span": "SELECT station, UNNEST(GENERATE_SERIES(MIN(year), MAX(year))) AS year FROM y GROUP BY 1",
    "annual": "SELECT station, year, tavg, COALESCE(prcp, 0) AS prcp FROM span LEFT JOIN y USING (station, year)",
}


def gapped(t):
    """The panel with an empty calendar year 1998."""
    day = F.col("Date")
    return panel(t).withColumn("Date", F.when(day >= F.lit("1998-01-01").cast("date"), F.date_add(day, 366)).otherwise(day))


@query("annual_summary", "station:s year:n tavg:f prcp:f", over("day", "SELECT * FROM annual", **ANNUAL))
def _annual(t):
    return K.annual_summary(gapped(t))


@query(
    "recent_years", "station:s year:n tavg:f prcp:f",
    over("day", "SELECT * FROM annual WHERE year > (SELECT MAX(b.year) FROM annual b WHERE b.station = annual.station) - 4",
         **ANNUAL),
)
def _recent(t):
    return recent_years(K.annual_summary(gapped(t)), 4)


@query(
    "station_kpis", "station:s rows:n mean_tavg:f mean_annual_prcp:f max_daily_prcp:f",
    over("day", """SELECT d.station, rows, mean_tavg, mean_annual_prcp, max_daily_prcp
                   FROM (SELECT station, COUNT(*) AS rows, AVG(tavg) AS mean_tavg, MAX(prcp) AS max_daily_prcp
                         FROM fx_day GROUP BY 1) d
                   JOIN (SELECT station, AVG(prcp) AS mean_annual_prcp FROM annual GROUP BY 1) a ON a.station = d.station""",
         **ANNUAL),
)
def _station_kpis(t):
    return K.station_kpis(gapped(t))


@query(
    "annual_sst", "year:n basin:s sst:f",
    over("sst", """SELECT YEAR(d) AS year, 'Pacific' AS basin, AVG((sst_pacific_f - 32) * 5 / 9) AS sst FROM sst GROUP BY 1
                   UNION ALL SELECT YEAR(d), 'Atlantic', AVG((sst_atlantic_f - 32) * 5 / 9) FROM sst GROUP BY 1
                   UNION ALL SELECT YEAR(d), 'Gulf', AVG((sst_gulf_f - 32) * 5 / 9) FROM sst GROUP BY 1"""),
)
def _annual_sst(t):
    return K.annual_sst(t.sst())


@query(
    "monthly_indices", "month_end:s enso_nino34:f pdo_index:f nao_index:f",
    over(
        "idx",
        """SELECT LAST_DAY(s.m) AS month_end, enso_nino34, pdo_index, nao_index FROM spine s LEFT JOIN means ON means.m = s.m""",
        means="""SELECT DATE_TRUNC('month', d) AS m, AVG(enso_nino34) AS enso_nino34, AVG(pdo_index) AS pdo_index,
                        AVG(nao_index) AS nao_index FROM idx GROUP BY 1""",
        spine="SELECT UNNEST(GENERATE_SERIES(CAST(MIN(m) AS TIMESTAMP), CAST(MAX(m) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM means",
    ),
)
def _indices(t):
    return K.monthly_indices(t.indices())


@query(
    "seasonal_climatology", "station:s month:n mean_tavg:f mean_daily_prcp:f",
    over("day", "SELECT station, MONTH(d) AS month, AVG(tavg) AS mean_tavg, AVG(prcp) AS mean_daily_prcp FROM day GROUP BY 1, 2"),
)
def _seasonal(t):
    return K.seasonal_climatology(panel(t))


@query(
    "trend_per_decade", "station:s trend_per_decade:f",
    over("day", "SELECT station, 10 * REGR_SLOPE(tavg, year) AS trend_per_decade FROM annual GROUP BY 1", **ANNUAL),
)
def _trend(t):
    return K.trend_per_decade(K.annual_summary(gapped(t)))


@query(
    "trend_line", "station:s year:n tavg:f slope:f fitted:f",
    over("day", """SELECT station, year, tavg, slope, intercept + slope * year AS fitted FROM annual
                   JOIN (SELECT station, REGR_SLOPE(tavg, year) AS slope, REGR_INTERCEPT(tavg, year) AS intercept
                         FROM annual GROUP BY 1) l USING (station)""", **ANNUAL),
)
def _line(t):
    return K.trend_line(K.annual_summary(gapped(t)))


@query(
    "station_profile",
    "station:s rows:n start:s end:s mean_tavg_c:f mean_annual_prcp_mm:f temperature_trend_c_per_decade:f max_daily_prcp_mm:f",
    over("day", f"""SELECT station, rows, start, "end", ROUND(mean, 3) AS mean_tavg_c, ROUND(annual_p, 3) AS mean_annual_prcp_mm,
                          ROUND(10 * slope, 4) AS temperature_trend_c_per_decade, ROUND(top, 3) AS max_daily_prcp_mm
                   FROM (SELECT station, COUNT(*) AS rows, strftime(MIN(d), '%Y-%m-%d') AS start,
                                strftime(MAX(d), '%Y-%m-%d') AS "end", AVG(tavg) AS mean, MAX(prcp) AS top
                         FROM ({GAPPED}) GROUP BY 1) f
                   JOIN (SELECT station, AVG(prcp) AS annual_p, REGR_SLOPE(tavg, year) AS slope FROM annual GROUP BY 1) a
                   USING (station)""", **ANNUAL),
)
def _profile(t):
    return K.station_profile(gapped(t))


PAIRED = ["tmax", "tmin", "tavg", "prcp", "dewpoint_f", "windspeed_mph", "pressure_hpa", "humidity_pct",
          "enso_nino34", "pdo_index", "nao_index", "sst_c"]


@query(
    "correlation_matrix", "x:s y:s corr:f",
    over(
        "day atm idx sst",
        " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, CORR({a}, {b}) AS corr FROM wide" for a in PAIRED for b in PAIRED),
        wide="""SELECT *, (sst_pacific_f - 32) * 5 / 9 AS sst_c FROM day LEFT JOIN atm USING (station, d)
                LEFT JOIN idx USING (d) LEFT JOIN sst USING (d)""",
    ),
)
def _correlation(t):
    aligned = align_modalities(panel(t), t.atmosphere(), t.indices(), t.sst())
    return K.correlation_matrix(aligned.toDF(*[c.lower() for c in aligned.columns]), PAIRED)


@query(
    "hazard_shares", "station:s extreme_heat_pct:f heavy_prcp_pct:f dry_pct:f",
    over(
        "day",
        """SELECT station, 100 * AVG(CASE WHEN tavg > t95 THEN 1 ELSE 0 END) AS extreme_heat_pct,
                  100 * AVG(CASE WHEN prcp > p90 THEN 1 ELSE 0 END) AS heavy_prcp_pct,
                  100 * AVG(CASE WHEN prcp < 0.1 THEN 1 ELSE 0 END) AS dry_pct FROM day JOIN q USING (station) GROUP BY 1""",
        q="SELECT station, QUANTILE_CONT(tavg, 0.95) AS t95, QUANTILE_CONT(prcp, 0.9) AS p90 FROM day GROUP BY 1",
    ),
)
def _shares(t):
    return K.hazard_shares(panel(t))


@query(
    "sst_kpis", "basin:s latest:f latest_date:s mean:f peak:f",
    over(
        "sst",
        " UNION ALL ".join(
            f"""SELECT '{name}' AS basin, ARG_MAX_NULL((sst_{name.lower()}_f - 32) * 5 / 9, d) AS latest,
                       strftime(MAX(d), '%Y-%m-%d') AS latest_date, AVG((sst_{name.lower()}_f - 32) * 5 / 9) AS mean,
                       MAX((sst_{name.lower()}_f - 32) * 5 / 9) AS peak FROM sst"""
            for name in ("Pacific", "Atlantic", "Gulf")
        ),
    ),
)
def _sst_kpis(t):
    return K.sst_kpis(t.sst())
