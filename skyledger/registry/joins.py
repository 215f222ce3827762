"""Auxiliary joins, carries, radius and interval joins."""

from pyspark.sql import functions as F

from skyledger.functions.hazards import ocean_basin
from skyledger.operators import enrichment as E
from skyledger.operators import timing
from skyledger.operators.chunks import join_by_station
from skyledger.operators.cleaning import derive_tavg
from skyledger.operators.radius import label_by_radius, repair_gaps
from skyledger.operators.rolling import saturation_percentile
from skyledger.registry.cleaning import HEALTH, health
from skyledger.registry.entries import query
from skyledger.registry.panel_sql import BASINS, COVERED, PLACED, carried
from skyledger.registry.proxies import over
from skyledger.schema import DAY, STATION

ATM = "dewpoint_f:f windspeed_mph:f pressure_hpa:f humidity_pct:f atmosphere_imputed:f atmosphere_donor_km:f"


@query(
    "join_atmosphere", f"station:s d:s tmax:f {ATM}",
    over("obs atm", "SELECT * FROM obs LEFT JOIN atm USING (station, d)"),
)
def _atmosphere(t):
    return E.join_atmosphere(t.obs().withColumn("dewpoint_f", F.lit(1.0)), t.atmosphere())


@query(
    "join_soil", "station:s d:s soil_moisture_vol:f saturation_pct:f soil_moisture_observed:f",
    over("obs soil", """SELECT o.station, o.d, s.soil_moisture_vol, s.saturation_pct,
                               CASE WHEN o.station NOT IN (SELECT station FROM soil) THEN 0 WHEN s.station IS NULL THEN NULL
                                    WHEN COALESCE(s.soil_moisture_vol, s.saturation_pct) IS NOT NULL THEN 1 ELSE 0
                               END AS soil_moisture_observed
                        FROM obs o LEFT JOIN soil s ON s.station = o.station AND s.d = o.d"""),
)
def _soil(t):
    return E.join_soil(t.obs(), t.soil())


INDEXED = {"joined": """SELECT o.station, o.d, i.enso_nino34, i.pdo_index, i.nao_index,
                               CASE WHEN COALESCE(i.enso_nino34, i.pdo_index, i.nao_index) IS NOT NULL THEN 1 ELSE 0 END AS seen
                        FROM obs o LEFT JOIN idx i ON i.d = o.d"""}


@query(
    "join_indices", "station:s d:s enso_nino34:f pdo_index:f nao_index:f climate_index_observed:f",
    over("obs idx", "SELECT *, seen AS climate_index_observed FROM joined", **INDEXED),
)
def _indices(t):
    return E.join_indices(t.obs(), t.indices(), fill=False)


@query(
    "fill_indices", "station:s d:s enso_nino34:f pdo_index:f nao_index:f climate_index_observed:f",
    over("obs idx", f"""SELECT station, d, {carried("enso_nino34")} AS enso_nino34, {carried("pdo_index")} AS pdo_index,
                               {carried("nao_index")} AS nao_index, seen AS climate_index_observed FROM joined""", **INDEXED),
)
def _fill(t):
    return E.join_indices(t.obs(), t.indices())


def placed_obs(t):
    places = t.stations().select(F.col("station_id").alias(STATION), F.col("lat").alias("LATITUDE"), F.col("lon").alias("LONGITUDE"))
    return join_by_station(t.obs(), places, "left")


SEA = {
    "basins": BASINS, "placed": PLACED,
    "joined": """SELECT o.station, o.d, p.basin, b.celsius FROM obs o LEFT JOIN placed p ON p.station = o.station
                 LEFT JOIN basins b ON b.d = o.d AND b.basin = p.basin""",
}


@query(
    "join_sst_daily", "station:s d:s sst:f", over("obs sst stations", "SELECT station, d, celsius AS sst FROM joined", **SEA)
)
def _sst(t):
    return E.join_sst_daily(placed_obs(t), t.sst(), fill=False)


@query(
    "fill_sst", "station:s d:s sst:f",
    over("obs sst stations", f"""SELECT station, d, COALESCE({carried("celsius")}, (SELECT AVG(x.celsius) FROM basins x
                                 WHERE x.basin = j.basin), 18) AS sst FROM joined j""", **SEA),
)
def _sst_fill(t):
    return E.join_sst_daily(placed_obs(t), t.sst())


@query(
    "join_sst_monthly", "station:s d:s sst:f",
    over(
        "obs sst", f"SELECT station, d, COALESCE({carried('c')}, (SELECT AVG(c) FROM months), 18) AS sst FROM joined",
        # Every July counts for fifty years before, so that the panel has months without a value.
        months="""SELECT YEAR(d) - CASE WHEN MONTH(d) = 7 THEN 50 ELSE 0 END AS y, MONTH(d) AS m,
                         (AVG(sst_pacific_f) - 32) * 5 / 9 AS c FROM sst GROUP BY 1, 2""",
        joined="SELECT o.station, o.d, c FROM obs o LEFT JOIN months ON y = YEAR(o.d) AND m = MONTH(o.d)",
    ),
)
def _sst_monthly(t):
    year = F.year(DAY) - F.when(F.month(DAY) == 7, 50).otherwise(0)
    monthly = t.sst().groupBy(year.alias("Year"), F.month(DAY).alias("Month")).agg(
        ((F.avg("sst_pacific_f") - 32) * 5 / 9).alias("SST_Mean_Celsius")
    )
    return E.join_sst_monthly(t.obs(), monthly)


@query(
    "ocean_basin", "station_id:s basin:s",
    over("stations", "SELECT station AS station_id, basin FROM placed", placed=PLACED),
)
def _basin(t):
    return t.stations().withColumn("basin", ocean_basin(F.col("station_id"), F.col("lat"), F.col("lon")))


@query(
    "dedup_labels", "station:s d:s event_label:i event_type:s event_distance_km:f", over("dlab", "SELECT * FROM dlab")
)
def _dedup(t):
    return E.dedup_labels(t.labels())


LABELLED = "station:s d:s event_label:f event_type:s event_distance_km:f event_label_available:i"


@query(
    "join_event_labels", LABELLED,
    over("obs dlab", """SELECT o.station, o.d, l.event_label, COALESCE(l.event_type, '') AS event_type, l.event_distance_km,
                               CASE WHEN l.station IS NULL THEN 0 ELSE 1 END AS event_label_available
                        FROM obs o LEFT JOIN dlab l ON l.station = o.station AND l.d = o.d"""),
)
def _labels(t):
    return E.join_event_labels(t.obs(), t.labels())


@query(
    "label_coverage", LABELLED,
    over(
        "obs dlab",
        f"""SELECT station, d, event_type, event_distance_km,
                   CASE WHEN {COVERED} THEN COALESCE(event_label, 0) ELSE event_label END AS event_label,
                   CASE WHEN {COVERED} THEN 1 ELSE hit END AS event_label_available FROM joined""",
        joined="""SELECT o.station, o.d, l.event_label, COALESCE(l.event_type, '') AS event_type, l.event_distance_km,
                         CASE WHEN l.station IS NULL THEN 0 ELSE 1 END AS hit
                  FROM obs o LEFT JOIN dlab l ON l.station = o.station AND l.d = o.d""",
    ),
)
def _coverage(t):
    return E.label_coverage(E.join_event_labels(t.obs(), t.labels()), t.labels())


@query(
    "align_modalities", f"station:s d:s tmax:f tavg:f {ATM} enso_nino34:f pdo_index:f nao_index:f sst_c:f",
    over("day atm idx sst", """SELECT *, (sst_pacific_f - 32) * 5 / 9 AS sst_c FROM day LEFT JOIN atm USING (station, d)
                               LEFT JOIN idx USING (d) LEFT JOIN sst USING (d)"""),
)
def _align(t):
    return E.align_modalities(derive_tavg(t.obs()), t.atmosphere(), t.indices(), t.sst())


@query(
    "align_fusion_inputs", "station:s d:s temp_pred:f hazard_prob:f",
    over("day atm", """SELECT station, d, tavg / 64 AS temp_pred, humidity_pct / 128 AS hazard_prob
                       FROM day JOIN atm USING (station, d)"""),
)
def _fusion(t):
    sequence = derive_tavg(t.obs()).select(STATION, DAY, (F.col("TAVG") / 64).alias("temp_pred"))
    tabular = t.atmosphere().select(STATION, DAY, (F.col("HUMIDITY_PCT") / 128).alias("hazard_prob"))
    return E.align_fusion_inputs(sequence, tabular)


@query(
    "station_quality", "station_id:s name:s training_ready:i core_completeness_pct:f",
    over("obs stations", """SELECT s.station AS station_id, s.name, COALESCE(training_ready, TRUE) AS training_ready,
                                   COALESCE(core_completeness_pct, 0) AS core_completeness_pct
                            FROM stations s LEFT JOIN health h ON h.station_id = s.station AND h.errors > 0""", **HEALTH),
)
def _quality(t):
    return E.station_quality(t.stations(), health(t).filter("errors > 0"))


KM = """2 * 6371.0088::DOUBLE * ASIN(SQRT(LEAST(1, POW(SIN(RADIANS({b}.lat - {a}.lat) / 2), 2)
        + COS(RADIANS({a}.lat)) * COS(RADIANS({b}.lat)) * POW(SIN(RADIANS({b}.lon - {a}.lon) / 2), 2))))"""


@query(
    "label_by_radius", "station:s d:s event_label:i event_type:s event_distance_km:f",
    over(
        "storms stations",
        """SELECT station, d, 1 AS event_label, STRING_AGG(DISTINCT event_type, '; ' ORDER BY event_type) AS event_type,
                  MIN(km) AS event_distance_km FROM pairs WHERE km <= 100 GROUP BY 1, 2""",
        pairs=f"""SELECT s.station, e.d, e.event_type, {KM.format(a="e", b="s")} AS km
                  FROM (SELECT DISTINCT d, lat, lon, event_type FROM storms) e, stations s""".replace(
            "stations s", "fx_stations s"),
    ),
)
def _radius(t):
    return label_by_radius(t.storms(), t.stations(), km=100.0)


@query(
    "repair_gaps", "station:s d:s pressure_hpa:f atmosphere_imputed:f atmosphere_donor_km:f",
    over(
        "atm stations",
        """SELECT a.station, a.d, COALESCE(a.pressure_hpa, b.value) AS pressure_hpa,
                  CASE WHEN b.station IS NULL THEN 0 ELSE 1 END AS atmosphere_imputed, COALESCE(b.km, 0) AS atmosphere_donor_km
           FROM atm a LEFT JOIN best b ON b.station = a.station AND b.d = a.d AND b.rank = 1""",
        near=f"""SELECT a.station, b.station AS donor, {KM.format(a="a", b="b")} AS km
                 FROM fx_stations a JOIN fx_stations b ON a.station <> b.station""",
        best="""SELECT g.station, g.d, n.km, v.pressure_hpa AS value,
                       ROW_NUMBER() OVER (PARTITION BY g.station, g.d ORDER BY ROUND(n.km, 6), n.donor) AS rank
                FROM atm g JOIN near n ON n.station = g.station AND n.km <= 400
                JOIN fx_atm v ON v.station = n.donor AND v.d = g.d AND v.pressure_hpa IS NOT NULL
                WHERE g.pressure_hpa IS NULL""",
    ),
)
def _repair(t):
    return repair_gaps(t.atmosphere(), t.stations(), "PRESSURE_HPA", max_km=400.0)


CHIP_LABELS = {
    "near": """SELECT c.chip_id, c.station, c.ts, EPOCH_US(c.ts) - EPOCH_US(s.ts) AS us
               FROM chips c LEFT JOIN fx_storms s ON s.station = c.station AND s.ts BETWEEN c.ts - INTERVAL 12 HOUR AND c.ts + INTERVAL 12 HOUR""",
    "marked": """SELECT chip_id, station, ts, CASE WHEN BOOL_OR(COALESCE(us <= 6 * 3600000000 AND us >= -6 * 3600000000, FALSE)) THEN 1
                        WHEN COUNT(us) > 0 THEN -1 ELSE 0 END AS label FROM near GROUP BY 1, 2, 3""",
}


@query(
    "label_chips", "chip_id:n station:s label:i",
    over("chips storms", "SELECT chip_id, station, label FROM marked", **CHIP_LABELS),
)
def _chips(t):
    return timing.label_chips(t.chips(), t.storms())


@query(
    "class_balance", "label:i rows:n",
    over("chips storms", "SELECT label, COUNT(*) AS rows FROM marked GROUP BY 1", **CHIP_LABELS),
)
def _balance(t):
    from skyledger.operators.climatology import class_balance

    return class_balance(timing.label_chips(t.chips(), t.storms()))


@query(
    "event_dates", "station:s d:s",
    over("obs lab", "SELECT station, d FROM obs o WHERE EXISTS (SELECT 1 FROM lab l WHERE l.station = o.station AND l.d = o.d AND l.event_label = 1)"),
)
def _event_dates(t):
    return timing.event_dates(t.obs().select(STATION, DAY), t.labels())


@query(
    "quiet_dates", "rows:n with_event:n",
    over("obs lab", """SELECT LEAST(200, COUNT(*)) AS rows, 0 AS with_event FROM obs o WHERE NOT EXISTS
                        (SELECT 1 FROM fx_lab l WHERE l.station = o.station AND l.d = o.d AND l.event_label = 1)"""),
)
def _quiet(t):
    drawn = timing.quiet_dates(t.obs().select(STATION, DAY), t.labels(), 200)
    events = timing.event_dates(t.obs().select(STATION, DAY), t.labels()).withColumn("_e", F.lit(1))
    return drawn.join(events, [STATION, DAY], "left").agg(F.count(F.lit(1)).alias("rows"), F.count("_e").alias("with_event"))


@query(
    "join_chip_tabular", "chip_id:n station:s intensity:f storms:n",
    over("chips storms", """SELECT chip_id, station, intensity, n AS storms FROM chips
                            JOIN (SELECT station AS st, d, COUNT(*) AS n FROM fx_storms GROUP BY 1, 2) x
                            ON st = station AND d = CAST(ts AS DATE)"""),
)
def _chip_tabular(t):
    scores = t.storms().groupBy(STATION, DAY).agg(F.count(F.lit(1)).alias("storms"))
    return timing.join_chip_tabular(t.chips(), scores)


@query(
    "saturation_percentile", "station:s d:s saturation_pctl:f",
    over("soil", """SELECT station, d, CASE WHEN soil_moisture_vol IS NOT NULL THEN 100 * PERCENT_RANK() OVER (
                      PARTITION BY station, soil_moisture_vol IS NULL ORDER BY soil_moisture_vol) END AS saturation_pctl FROM soil"""),
)
def _saturation(t):
    return saturation_percentile(t.soil())
