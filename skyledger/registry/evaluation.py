"""Sequences, splits, scaling, weights, metrics, risk rules."""

from pyspark.sql import functions as F

from skyledger.functions import hazards as H
from skyledger.functions.columns import display_name, fahrenheit_to_celsius, flag, mph_to_kmh
from skyledger.operators import metrics as M
from skyledger.operators import rolling as R
from skyledger.operators import splits as S
from skyledger.operators.cleaning import derive_tavg
from skyledger.operators.climatology import split_manifest
from skyledger.operators.enrichment import join_event_labels, label_coverage
from skyledger.operators.lineage import settle
from skyledger.operators.learners import contributions, persistence_forecast
from skyledger.operators.picks import default_chip, sample_stations
from skyledger.operators.recent import recent_features
from skyledger.registry.entries import query
from skyledger.registry.features import light, light_panel
from skyledger.registry.panel_sql import COVERED
from skyledger.registry.proxies import over
from skyledger.schema import DAY, STATION

# Formulas -----------------------------------------------------------------------------------

FORMULAS = {
    "heat_index": """-8.78469475556::DOUBLE + 1.61139411::DOUBLE * tavg + 2.33854883889::DOUBLE * dew
        - 0.14611605::DOUBLE * tavg * dew - 0.012308094::DOUBLE * tavg * tavg - 0.016424828::DOUBLE * dew * dew
        + 0.002211732::DOUBLE * tavg * tavg * dew + 0.00072546::DOUBLE * tavg * dew * dew
        - 0.000003582::DOUBLE * tavg * tavg * dew * dew""",
    "wind_chill": """13.12::DOUBLE + 0.6215::DOUBLE * tavg - 11.37::DOUBLE * POW(kmh, 0.16)
        + 0.3965::DOUBLE * tavg * POW(kmh, 0.16)""",
    "wet_bulb": """tavg * ATAN(0.151977::DOUBLE * root) + ATAN(tavg + dew) - ATAN(dew - 1.676331::DOUBLE)
        + 0.00391838::DOUBLE * CASE WHEN dew >= 0 THEN POW(dew, 1.5) END * ATAN(0.023101::DOUBLE * dew)
        - 4.686035::DOUBLE""",
    "wet_bulb_scoring": """tavg * ATAN(0.151977::DOUBLE * root) + ATAN(tavg + dew) - ATAN(dew - 1.676331::DOUBLE)
        + 0.00391838::DOUBLE * POW(CASE WHEN dew < 0 THEN 0 ELSE dew END, 1.5) * ATAN(0.023101::DOUBLE * dew)
        - 4.686035::DOUBLE""",
    "flood_risk": "prcp * (saturation_pct / 100)",
    "wind_risk": "windspeed_mph * (1013.25::DOUBLE / CASE WHEN pressure_hpa < 900 THEN 900 ELSE pressure_hpa END)",
}
PHYSICAL = {
    "cold": """SELECT *, (dewpoint_f - 20 - 32) * 5 / 9 AS dew, windspeed_mph * 1.60934::DOUBLE AS kmh FROM filled""",
    "rooted": "SELECT *, CASE WHEN dew + 8.313659 >= 0 THEN SQRT(dew + 8.313659::DOUBLE) END AS root FROM cold",
}


def physical(t):
    """The light panel with its dew points lowered, so that every branch of the formulas occurs."""
    panel = light_panel(t)
    dew = fahrenheit_to_celsius(F.col("DEWPOINT_F") - 20)
    return panel.withColumns({"_T": F.col("TAVG"), "_D": dew, "_W": mph_to_kmh(F.col("WINDSPEED_MPH"))})


for _name, _build in {
    "heat_index": lambda: H.heat_index(F.col("_T"), F.col("_D")),
    "wind_chill": lambda: H.wind_chill(F.col("_T"), F.col("_W")),
    "wet_bulb": lambda: H.wet_bulb(F.col("_T"), F.col("_D")),
    "wet_bulb_scoring": lambda: H.wet_bulb(F.col("_T"), F.col("_D"), mode="scoring"),
    "flood_risk": lambda: H.flood_risk(F.col("PRCP"), F.col("SATURATION_PCT")),
    "wind_risk": lambda: H.wind_risk(F.col("WINDSPEED_MPH"), F.col("PRESSURE_HPA")),
}.items():
    query(_name, "station:s d:s value:f", light(f"SELECT station, d, {FORMULAS[_name]} AS value FROM rooted", **PHYSICAL))(
        lambda t, build=_build: physical(t).withColumn("value", build())
    )


@query(
    "sst_air_diff", "station:s d:s sst_air_diff:f",
    over("day sst", "SELECT station, d, tavg - (sst_pacific_f - 32) * 5 / 9 AS sst_air_diff FROM day JOIN sst USING (d)"),
)
def _diff(t):
    joined = derive_tavg(t.obs()).join(t.sst(), DAY)
    return joined.withColumn("sst_air_diff", H.sst_air_diff(F.col("TAVG"), fahrenheit_to_celsius(F.col("sst_pacific_f"))))


@query(
    "risk_tier", "tier:s rows:n",
    over("scores", """SELECT CASE WHEN pct < 30 THEN 'Low Risk' WHEN pct < 60 THEN 'Moderate Alert'
                                  WHEN pct < 85 THEN 'Severe Warning' ELSE 'Extreme Danger' END AS tier, COUNT(*) AS rows
                      FROM (SELECT 125 * score - 10 AS pct FROM fx_scores) x GROUP BY 1"""),
)
def _tier(t):
    tiers = t.scores().withColumn("tier", H.risk_tier(F.col("score") * 125 - 10))
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "display_name", "station_id:s label:s",
    over("stations", """SELECT station AS station_id, 'Region Of ' || SUBSTR(station, 4) || ' (REGION_OF_' || SUBSTR(station, 4) || ')' AS label
                        FROM stations"""),
)
def _display(t):
    code = F.concat(F.lit("REGION_OF_"), F.substring("station_id", 4, 20))
    return t.stations().withColumn("label", display_name(code))


@query(
    "chip_channel_max", "index:n peak:f label:i",
    over("grids", "SELECT index, LIST_MAX(embedding) AS peak, label FROM grids"),
)
def _channel(t):
    return t.grids().withColumn("peak", H.chip_channel_max(F.col("grid")))


@query(
    "chip_category", "category:s rows:n",
    over("grids", """SELECT CASE WHEN p >= 0.5 THEN 'Severe Storm' WHEN peak <= 0.1 THEN 'Light Rain' ELSE 'Convective Activity' END
                            AS category, COUNT(*) AS rows
                     FROM (SELECT LIST_MAX(embedding) AS peak, CAST(index % 7 AS DOUBLE) / 8 AS p FROM fx_grids) x GROUP BY 1"""),
)
def _category(t):
    peak = H.chip_channel_max(F.col("grid"))
    rows = t.grids().withColumn("category", H.chip_category(F.col("index") % 7 / 8.0, peak, light_cut=0.1))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "default_chip", "index:n",
    over("grids", """SELECT COALESCE(MIN(CASE WHEN label = 1 AND LIST_MAX(embedding) > 0.3 THEN index END),
                                     MIN(CASE WHEN label = 1 THEN index END), 0) AS index FROM grids"""),
)
def _default(t):
    return default_chip(t.grids().withColumn("max_reflectivity", H.chip_channel_max(F.col("grid"))), bright=0.3)


# Sequences and scoring inputs ---------------------------------------------------------------

SEQ = {
    "base": "SELECT station, d, tmax, tmin, tavg, prcp, tmin / 2 AS sst, CASE WHEN d < DATE '1999-01-01' THEN 'train' WHEN d < DATE '2000-06-01' THEN 'validation' ELSE 'test' END AS split FROM day",
    "whole": "SELECT station, d, split, " + ", ".join(
        f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY station, split ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
        f" FIRST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY station, split ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 18) AS {c}"
        for c in ("tmax", "tmin", "tavg", "prcp", "sst")) + " FROM base",
    "windows": """SELECT station, d, split, tavg AS target, COUNT(*) OVER w AS n, SUM(tmax) OVER w AS tmax, SUM(prcp) OVER w AS prcp,
                         SUM(sst) OVER w AS sst, FIRST_VALUE(tavg) OVER w AS first_tavg, LAST_VALUE(tmin) OVER w AS last_tmin
                  FROM whole WINDOW w AS (PARTITION BY station, split ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""",
}


def split_panel(t):
    panel = derive_tavg(t.obs()).withColumn("SST", F.col("TMIN") / 2)
    return panel.withColumn("split", S.by_dates(F.col(DAY), "1999-01-01", "2000-06-01"))


@query(
    "sequences_30", "station:s d:s split:s target:f tmax:f prcp:f sst:f first_tavg:f last_tmin:f",
    over("day", "SELECT * FROM windows WHERE n = 30", **SEQ),
)
def _sequences(t):
    def total(c):
        return F.aggregate("sequence", F.lit(0.0), lambda a, s: a + s[c]).alias(c.lower())

    return R.sequences(split_panel(t)).select(
        STATION, DAY, "split", "target", total("TMAX"), total("PRCP"), total("SST"),
        F.col("sequence")[0]["TAVG"].alias("first_tavg"), F.col("sequence")[29]["TMIN"].alias("last_tmin"),
    )


TODAY = "SELECT station, MAX(tmax) AS tmax, MIN(tmin) AS tmin, MAX(prcp) AS prcp FROM obs GROUP BY 1"


def today(t):
    return t.obs().groupBy(STATION).agg(F.max("TMAX").alias("TMAX"), F.min("TMIN").alias("TMIN"), F.max("PRCP").alias("PRCP"))


@query(
    "scoring_sequence", "station:s steps:n first_tavg:f tmax:f last_tavg:f last_sst:f",
    over(
        "day",
        """SELECT station, 30 AS steps, first_tavg, tmax + (30 - n) * first_tmax AS tmax, last_tavg, last_sst
           FROM (SELECT station, COUNT(*) AS n, ARG_MAX(tavg, age) AS first_tavg, ARG_MAX(tmax, age) AS first_tmax, SUM(tmax) AS tmax,
                        ARG_MIN(tavg, age) AS last_tavg, ARG_MIN(sst, age) AS last_sst FROM whole GROUP BY 1) x""",
        now=TODAY.replace("FROM obs", "FROM fx_obs"),
        tail="""SELECT station, age, tmax, tmin, tavg, prcp, sst FROM (SELECT *, tmin / 2 AS sst,
                ROW_NUMBER() OVER (PARTITION BY station ORDER BY d DESC) AS age FROM fx_day) x WHERE age <= 29
                UNION ALL SELECT n.station, 0, n.tmax, n.tmin, (n.tmax + n.tmin) / 2, n.prcp, l.tmin / 2 FROM now n
                JOIN (SELECT station, ARG_MAX(tmin, d) AS tmin FROM fx_day GROUP BY 1) l ON l.station = n.station""",
        whole="SELECT station, age, " + ", ".join(
            f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY age DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
            f" FIRST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY age DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 18) AS {c}"
            for c in ("tmax", "tmin", "tavg", "prcp", "sst")) + " FROM tail",
    ),
)
def _scoring(t):
    history = derive_tavg(t.obs()).withColumn("SST", F.col("TMIN") / 2)
    s = F.col("sequence")
    return R.scoring_sequences(history, today(t)).select(
        STATION, F.size(s).alias("steps"), s[0]["TAVG"].alias("first_tavg"),
        F.aggregate(s, F.lit(0.0), lambda a, x: a + x["TMAX"]).alias("tmax"),
        s[29]["TAVG"].alias("last_tavg"), s[29]["SST"].alias("last_sst"),
    )


@query(
    "latest_valid", "station:s pressure_hpa:f dewpoint_f:f",
    over("atm", """SELECT station, COALESCE(ARG_MAX(pressure_hpa, d) FILTER (WHERE pressure_hpa IS NOT NULL), 1013.25::DOUBLE) AS pressure_hpa,
                          COALESCE(ARG_MAX(dewpoint_f, d) FILTER (WHERE dewpoint_f IS NOT NULL), 0) AS dewpoint_f
                   FROM atm GROUP BY 1"""),
)
def _latest(t):
    return R.latest_valid(t.atmosphere(), {"PRESSURE_HPA": 1013.25, "DEWPOINT_F": 0.0})


def _tail(n: int, column: str, how: str) -> str:
    return f"{how}(CASE WHEN age <= {n - 1} THEN {column} END)"


@query(
    "recent_features",
    "station:s prcp_3d:f prcp_7d:f prcp_30d:f prcp_max_7d:f wind_max_7d:f pressure_drop_3d:f saturation_max_7d:f"
    " soil_moisture_anom_30d:f temp_anom_7d:f drought_idx:f temp_anom:f prcp_anom:f extreme_heat:f extreme_cold:f sst:f"
    " pressure_hpa:f flood_risk_idx:f wind_risk_idx:f",
    over(
        "obs atm soil",
        """SELECT station, COALESCE(r3, 0) + p AS prcp_3d, COALESCE(r7, 0) + p AS prcp_7d, COALESCE(r30, 0) + p AS prcp_30d,
                  GREATEST(COALESCE(rmax, 0), p) AS prcp_max_7d, GREATEST(wmax, w) AS wind_max_7d,
                  GREATEST(pmax, pressure) - pressure AS pressure_drop_3d, GREATEST(smax, saturation) AS saturation_max_7d,
                  soil - (COALESCE(ssum, 0) + (sgap + 1) * soil) / (srow + 1) AS soil_moisture_anom_30d,
                  t - (COALESCE(tsum, 0) + (tgap + 1) * t) / (trow + 1) AS temp_anom_7d,
                  GREATEST(mp - rp, 0) AS drought_idx, t - mt AS temp_anom, p - mp AS prcp_anom,
                  CASE WHEN t > t95 THEN 1 ELSE 0 END AS extreme_heat, CASE WHEN t < t05 THEN 1 ELSE 0 END AS extreme_cold,
                  18 AS sst, pressure AS pressure_hpa, p * (saturation / 100) AS flood_risk_idx,
                  w * (1013.25::DOUBLE / GREATEST(pressure, 900)) AS wind_risk_idx
           FROM tails JOIN totals USING (station) JOIN now USING (station)""",
        h="SELECT * FROM fx_obs LEFT JOIN fx_atm USING (station, d) LEFT JOIN fx_soil USING (station, d)",
        now="SELECT station, MAX(tmax) + 1 AS t, 12 AS w, CAST(MAX(prcp) AS DOUBLE) AS p FROM fx_obs GROUP BY 1",
        totals="""SELECT station, AVG(tmax) AS mt, AVG(prcp) AS mp, QUANTILE_CONT(tmax, 0.95) AS t95, QUANTILE_CONT(tmax, 0.05) AS t05,
                         COALESCE(ARG_MAX(pressure_hpa, d) FILTER (WHERE pressure_hpa IS NOT NULL), 1013.25::DOUBLE) AS pressure,
                         COALESCE(ARG_MAX(saturation_pct, d) FILTER (WHERE saturation_pct IS NOT NULL), 40) AS saturation,
                         COALESCE(ARG_MAX(soil_moisture_vol, d) FILTER (WHERE soil_moisture_vol IS NOT NULL), 0.2::DOUBLE) AS soil
                  FROM h GROUP BY 1""",
        aged="SELECT *, ROW_NUMBER() OVER (PARTITION BY station ORDER BY d DESC) AS age FROM h",
        tails=f"""SELECT station, {_tail(3, "prcp", "SUM")} AS r3, {_tail(7, "prcp", "SUM")} AS r7, {_tail(30, "prcp", "SUM")} AS r30,
                         {_tail(7, "prcp", "MAX")} AS rmax, {_tail(7, "windspeed_mph", "MAX")} AS wmax,
                         {_tail(3, "pressure_hpa", "MAX")} AS pmax, {_tail(7, "saturation_pct", "MAX")} AS smax,
                         {_tail(30, "soil_moisture_vol", "SUM")} AS ssum,
                         COUNT(CASE WHEN age <= 29 AND soil_moisture_vol IS NULL THEN 1 END) AS sgap,
                         COUNT(CASE WHEN age <= 29 THEN 1 END) AS srow, {_tail(7, "tmax", "SUM")} AS tsum,
                         COUNT(CASE WHEN age <= 6 AND tmax IS NULL THEN 1 END) AS tgap, COUNT(CASE WHEN age <= 6 THEN 1 END) AS trow,
                         AVG(CASE WHEN age <= 30 THEN prcp END) AS rp FROM aged GROUP BY 1""",
    ),
)
def _recent(t):
    history = settle(t.obs().join(t.atmosphere(), [STATION, DAY], "left").join(t.soil(), [STATION, DAY], "left"), "history")
    now = t.obs().groupBy(STATION).agg(
        (F.max("TMAX") + 1).alias("T"), F.lit(10.0).alias("D"), F.lit(12 * 1.60934).alias("W"), F.max("PRCP").alias("P")
    )
    return recent_features(history, now)


# Splits, scaling, weights -------------------------------------------------------------------

CUT = {
    "days": "SELECT d, COUNT(*) AS n FROM obs GROUP BY 1",
    "ranked": "SELECT d, SUM(n) OVER (ORDER BY d) - n AS below, SUM(n) OVER () AS total FROM days",
    "cuts": """SELECT d, CASE WHEN below < FLOOR(total * 70 / 100) THEN 'train' WHEN below < FLOOR(total * 85 / 100) THEN 'validation'
                              ELSE 'test' END AS split FROM ranked""",
}


@query(
    "chronological_split", "station:s d:s split:s",
    over("obs", "SELECT station, d, split FROM obs JOIN cuts USING (d)", **CUT),
)
def _split(t):
    return S.chronological_split(t.obs())


@query(
    "split_manifest", "split:s rows:n start:s end:s stations:n labelled_rows:n",
    over(
        "obs dlab",
        """SELECT split, COUNT(*) AS rows, strftime(MIN(d), '%Y-%m-%d') AS start, strftime(MAX(d), '%Y-%m-%d') AS "end",
                  COUNT(DISTINCT station) AS stations, SUM(CASE WHEN l IS NULL THEN 0 ELSE 1 END) AS labelled_rows
           FROM (SELECT o.station, o.d, split, x.event_label AS l FROM fx_obs o JOIN cuts ON cuts.d = o.d
                 LEFT JOIN fx_dlab x ON x.station = o.station AND x.d = o.d) y GROUP BY 1""", **CUT,
    ),
)
def _manifest(t):
    return split_manifest(S.chronological_split(join_event_labels(t.obs(), t.labels())))


@query(
    "event_split", "split:s event_label:i rows:n",
    over(
        "obs dlab",
        f"""SELECT CASE WHEN d < DATE '2001-01-01' THEN 'train' WHEN d < DATE '2001-06-01' THEN 'validation' ELSE 'test' END AS split,
                  COALESCE(event_label, 0) AS event_label, COUNT(*) AS rows FROM joined WHERE {COVERED} OR hit = 1 GROUP BY 1, 2""",
        joined="""SELECT o.station, o.d, l.event_label, CASE WHEN l.station IS NULL THEN 0 ELSE 1 END AS hit
                  FROM obs o LEFT JOIN dlab l ON l.station = o.station AND l.d = o.d""",
    ),
)
def _event_split(t):
    covered = label_coverage(join_event_labels(t.obs(), t.labels()), t.labels())
    parts = S.event_split(covered, "2001-01-01", "2001-06-01")
    return parts.groupBy("split", "EVENT_LABEL").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "event_readiness", "rows:n train_rows:n validation_rows:n test_rows:n trained:i reason:s",
    over(
        "obs dlab",
        f"""SELECT COUNT(*) AS rows, COUNT(CASE WHEN d < DATE '2023-01-01' THEN 1 END) AS train_rows, 0 AS validation_rows,
                  0 AS test_rows, 0 AS trained, 'event split too small or single class' AS reason FROM joined
           WHERE {COVERED} OR hit = 1""",
        joined="""SELECT o.station, o.d, CASE WHEN l.station IS NULL THEN 0 ELSE 1 END AS hit
                  FROM obs o LEFT JOIN dlab l ON l.station = o.station AND l.d = o.d""",
    ),
)
def _readiness(t):
    covered = label_coverage(join_event_labels(t.obs(), t.labels()), t.labels())
    return S.event_readiness(S.event_split(covered))


@query(
    "minmax_scale", "station:s d:s tmax:f tmin:f flat:f",
    over("obs", """SELECT station, d, (tmax - (SELECT MIN(tmax) FROM fx_obs WHERE d < DATE '1999-01-01'))
                          / (SELECT MAX(tmax) - MIN(tmax) FROM fx_obs WHERE d < DATE '1999-01-01') AS tmax,
                          (tmin - (SELECT MIN(tmin) FROM fx_obs WHERE d < DATE '1999-01-01'))
                          / (SELECT MAX(tmin) - MIN(tmin) FROM fx_obs WHERE d < DATE '1999-01-01') AS tmin, 0 AS flat FROM obs"""),
)
def _minmax(t):
    panel = t.obs().withColumn("FLAT", F.lit(3.0))
    return S.minmax_fit(panel.filter(F.col(DAY) < "1999-01-01"), ["TMAX", "TMIN", "FLAT"]).transform(panel)


@query(
    "class_weights", "y:i rows:n weight:f",
    over("scores", """SELECT y, COUNT(*) AS rows, (SELECT COUNT(*) FROM fx_scores)
                             / ((SELECT COUNT(DISTINCT y) FROM fx_scores) * CAST(COUNT(*) AS DOUBLE)) AS weight FROM scores GROUP BY 1"""),
)
def _weights(t):
    return S.class_weights(t.scores(), "y")


# Metrics ------------------------------------------------------------------------------------


@query(
    "tune_threshold", "threshold:f f1:f",
    over(
        "scores", "SELECT threshold, f1 FROM graded ORDER BY ROUND(f1, 12) DESC, threshold LIMIT 1",
        bins="SELECT y, FLOOR((score - 0.05 + 1e-9) * 100) AS bin FROM fx_scores",
        histogram="SELECT bin, SUM(y) AS pos, COUNT(*) AS n FROM bins GROUP BY 1",
        graded="""SELECT CAST(5 + k AS DOUBLE) / 100 AS threshold, 2 * CAST(SUM(CASE WHEN bin >= k THEN pos ELSE 0 END) AS DOUBLE)
                         / (SUM(CASE WHEN bin >= k THEN n ELSE 0 END) + SUM(pos)) AS f1
                  FROM histogram, RANGE(91) r(k) GROUP BY k""",
    ),
)
def _threshold(t):
    return M.tune_threshold(t.scores(), "y", "score")


CELLS = {
    "cells": """SELECT part, COUNT(CASE WHEN y = 1 AND called THEN 1 END) AS tp, COUNT(CASE WHEN y = 0 AND called THEN 1 END) AS fp,
                       COUNT(CASE WHEN y = 1 AND NOT called THEN 1 END) AS fn, COUNT(CASE WHEN y = 0 AND NOT called THEN 1 END) AS tn
                FROM (SELECT part, y, score >= 0.6 AS called FROM fx_scores) x GROUP BY 1"""
}


@query(
    "classification_metrics", "part:s tp:n fp:n fn:n tn:n accuracy:f precision:f recall:f f1:f positive_rate:f",
    over(
        "scores",
        """SELECT *, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
                  CAST(tp AS DOUBLE) / (tp + fn) AS recall, 2 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn) AS f1,
                  CAST(tp + fn AS DOUBLE) / (tp + fp + fn + tn) AS positive_rate FROM cells""", **CELLS,
    ),
)
def _classification(t):
    called = t.scores().withColumn("called", flag(F.col("score") >= 0.6))
    return M.classification_metrics(called, "y", "called", ["part"])


def curve(score: str) -> dict[str, str]:
    return {
        "levels": f"SELECT part, {score} AS s, SUM(y) AS pos, COUNT(*) AS n FROM fx_scores GROUP BY 1, 2",
        "ranked": """SELECT *, SUM(n - pos) OVER (PARTITION BY part ORDER BY s) - (n - pos) AS neg_below,
                            SUM(pos) OVER (PARTITION BY part ORDER BY s DESC) AS tp,
                            SUM(n) OVER (PARTITION BY part ORDER BY s DESC) AS called,
                            SUM(pos) OVER (PARTITION BY part) AS p, SUM(n) OVER (PARTITION BY part) AS t FROM levels""",
    }


for _label, _score in (("", "score"), ("_tied", "tied")):
    query(
        f"roc_auc{_label}", "part:s rows:n positives:n roc_auc:f",
        over("scores", """SELECT part, MAX(t) AS rows, MAX(p) AS positives,
                                 SUM(CAST(pos AS DOUBLE) * (neg_below + 0.5 * (n - pos))) / (MAX(p) * CAST(MAX(t) - MAX(p) AS DOUBLE)) AS roc_auc
                          FROM ranked GROUP BY 1""", **curve(_score)),
    )(lambda t, s=_score: M.roc_auc(t.scores(), "y", s, ["part"]))
    query(
        f"average_precision{_label}", "part:s rows:n positives:n average_precision:f",
        over("scores", """SELECT part, MAX(t) AS rows, MAX(p) AS positives,
                                 SUM(CAST(pos AS DOUBLE) * tp / called) / MAX(p) AS average_precision
                          FROM ranked GROUP BY 1""", **curve(_score)),
    )(lambda t, s=_score: M.average_precision(t.scores(), "y", s, ["part"]))


@query(
    "regression_metrics", "rows:n mse_scaled:f r2:f mae:f rmse:f",
    over(
        "day",
        """SELECT COUNT(*) AS rows, AVG((t - y) * (t - y)) AS mse_scaled, 1 - AVG((t - y) * (t - y)) / VAR_POP(t) AS r2,
                  AVG(ABS(t - y)) * 40 AS mae, SQRT(AVG((t - y) * (t - y))) * 40 AS rmse
           FROM pairs WHERE t IS NOT NULL AND y IS NOT NULL""",
        pairs="""SELECT LEAD(tavg) OVER (PARTITION BY station ORDER BY d) / 64 AS t, tavg / 64 AS y FROM day""",
    ),
)
def _regression(t):
    forecast = persistence_forecast(derive_tavg(t.obs()))
    scaled = forecast.withColumns({"y": F.col("target") / 64, "yhat": F.col("predicted") / 64})
    return M.regression_metrics(scaled, "y", "yhat", low=-12.0, span=40.0)


@query(
    "event_subset_metrics", "rows:n accuracy:f roc_auc:f",
    over(
        "scores",
        """SELECT MAX(t) AS rows, (SELECT AVG(CASE WHEN (score > 0.5) = (y = 1) THEN 1 ELSE 0 END) FROM fx_scores WHERE part = 'F') AS accuracy,
                  SUM(CAST(pos AS DOUBLE) * (neg_below + 0.5 * (n - pos))) / (MAX(p) * CAST(MAX(t) - MAX(p) AS DOUBLE)) AS roc_auc
           FROM ranked WHERE part = 'F'""", **curve("score"),
    ),
)
def _subset(t):
    rows = t.scores().withColumns({"covered": flag(F.col("part") == "F"), "hazard_prob": F.col("score")})
    return M.event_subset_metrics(rows, label="y", available="covered")


@query(
    "contributions", "station:s d:s a:f b:f c:f",
    over("obs", """SELECT station, d, CASE WHEN s > 0 THEN x / s ELSE 0.1 END AS a, CASE WHEN s > 0 THEN y / s ELSE 0.1 END AS b,
                          CASE WHEN s > 0 THEN z / s ELSE 0.1 END AS c
                   FROM (SELECT station, d, COALESCE(tmax, 0) * 0.5 AS x, tmin * 0.25 AS y, COALESCE(prcp, 0) * 0.25 AS z,
                                COALESCE(tmax, 0) * 0.5 + tmin * 0.25 + COALESCE(prcp, 0) * 0.25 AS s FROM fx_obs) q"""),
)
def _contributions(t):
    shares = contributions(["TMAX", "TMIN", "PRCP"], [0.5, 0.25, 0.25])
    rows = t.obs().withColumn("_c", shares)
    return rows.withColumns({"a": F.col("_c")[0], "b": F.col("_c")[1], "c": F.col("_c")[2]})


@query(
    "sample_stations", "stations:n distinct_stations:n unknown:n",
    over("stations", "SELECT LEAST(7, COUNT(*)) AS stations, LEAST(7, COUNT(*)) AS distinct_stations, 0 AS unknown FROM stations"),
)
def _sample(t):
    drawn = sample_stations(t.stations().select("station_id"), 7)
    known = t.stations().select("station_id", F.lit(1).alias("_k"))
    return drawn.join(known, "station_id", "left").agg(
        F.count(F.lit(1)).alias("stations"), F.countDistinct("station_id").alias("distinct_stations"),
        F.count_if(F.col("_k").isNull()).alias("unknown"),
    )
