"""SQL views of the assembled, filled, windowed and scored panel, for the feature queries."""

W = "OVER (PARTITION BY station ORDER BY d ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def back(rows: int) -> str:
    return W.format(n=rows - 1)


def carried(column: str) -> str:
    return (
        f"COALESCE(LAST_VALUE({column} IGNORE NULLS) OVER (PARTITION BY station ORDER BY d"
        f" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
        f" FIRST_VALUE({column} IGNORE NULLS) OVER (PARTITION BY station ORDER BY d"
        f" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


BASINS = """
    SELECT d, 'sst_pacific_f' AS basin, (sst_pacific_f - 32) * 5 / 9 AS celsius FROM sst
    UNION ALL SELECT d, 'sst_atlantic_f', (sst_atlantic_f - 32) * 5 / 9 FROM sst
    UNION ALL SELECT d, 'sst_gulf_f', (sst_gulf_f - 32) * 5 / 9 FROM sst"""

PLACED = """
    SELECT *, CASE WHEN lon <= -100 THEN 'sst_pacific_f' WHEN lat <= 31.5 AND lon <= -80 THEN 'sst_gulf_f'
                   ELSE 'sst_atlantic_f' END AS basin
    FROM stations"""

JOINED = """
    SELECT o.station, o.d, o.tmax, o.tmin, o.tavg, o.prcp, o.p,
           a.dewpoint_f, a.windspeed_mph, a.pressure_hpa, a.humidity_pct, a.atmosphere_imputed, a.atmosphere_donor_km,
           s.soil_moisture_vol, s.saturation_pct,
           CASE WHEN o.station NOT IN (SELECT station FROM soil) THEN 0
                WHEN s.station IS NULL THEN NULL
                WHEN COALESCE(s.soil_moisture_vol, s.saturation_pct) IS NOT NULL THEN 1 ELSE 0
           END AS soil_moisture_observed,
           i.enso_nino34, i.pdo_index, i.nao_index,
           CASE WHEN COALESCE(i.enso_nino34, i.pdo_index, i.nao_index) IS NOT NULL THEN 1 ELSE 0
           END AS climate_index_observed,
           t.lat AS latitude, t.lon AS longitude, t.elevation, t.basin, b.celsius,
           l.event_label, l.event_type, l.event_distance_km, CASE WHEN l.station IS NULL THEN 0 ELSE 1 END AS hit
    FROM day o
    LEFT JOIN atm a ON a.station = o.station AND a.d = o.d
    LEFT JOIN soil s ON s.station = o.station AND s.d = o.d
    LEFT JOIN idx i ON i.d = o.d
    LEFT JOIN placed t ON t.station = o.station
    LEFT JOIN basins b ON b.d = o.d AND b.basin = t.basin
    LEFT JOIN dlab l ON l.station = o.station AND l.d = o.d"""

COVERED = """(station IN (SELECT station FROM lab)
              AND d BETWEEN (SELECT MIN(d) FROM lab) AND (SELECT MAX(d) FROM lab))"""

ASSEMBLED = f"""
    SELECT station, d, tmax, tmin, tavg, prcp, p, dewpoint_f, windspeed_mph, pressure_hpa, humidity_pct,
           atmosphere_imputed, atmosphere_donor_km, soil_moisture_vol, saturation_pct, soil_moisture_observed,
           climate_index_observed, latitude, longitude, elevation, event_type_f AS event_type, event_distance_km,
           {carried("enso_nino34")} AS enso_nino34, {carried("pdo_index")} AS pdo_index,
           {carried("nao_index")} AS nao_index,
           COALESCE({carried("celsius")}, (SELECT AVG(x.celsius) FROM basins x WHERE x.basin = j.basin), 18) AS sst,
           CASE WHEN {COVERED} THEN COALESCE(event_label, 0) ELSE event_label END AS event_label,
           CASE WHEN {COVERED} THEN 1 ELSE hit END AS event_label_available
    FROM (SELECT *, COALESCE(event_type, '') AS event_type_f FROM joined) j"""

FILLED = """
    SELECT * REPLACE (
        COALESCE(dewpoint_f, tavg * 9 / 5 + 32 - 15) AS dewpoint_f, COALESCE(windspeed_mph, 5) AS windspeed_mph,
        COALESCE(pressure_hpa, 1013.25::DOUBLE) AS pressure_hpa, COALESCE(humidity_pct, 50) AS humidity_pct,
        COALESCE(soil_moisture_vol, 0.2::DOUBLE) AS soil_moisture_vol, COALESCE(saturation_pct, 40) AS saturation_pct,
        COALESCE(enso_nino34, 0) AS enso_nino34, COALESCE(pdo_index, 0) AS pdo_index,
        COALESCE(nao_index, 0) AS nao_index, COALESCE(atmosphere_imputed, 0) AS atmosphere_imputed,
        COALESCE(atmosphere_donor_km, 0) AS atmosphere_donor_km,
        COALESCE(soil_moisture_observed, 1) AS soil_moisture_observed,
        COALESCE(climate_index_observed, 1) AS climate_index_observed,
        COALESCE(latitude, 0) AS latitude, COALESCE(longitude, 0) AS longitude, COALESCE(elevation, 0) AS elevation)
    FROM assembled"""

WINDOWED = f"""
    SELECT *, (dewpoint_f - 32) * 5 / 9 AS dew, windspeed_mph * 1.60934::DOUBLE AS kmh,
           SUM(p) {back(3)} AS prcp_3d, SUM(p) {back(7)} AS prcp_7d, SUM(p) {back(14)} AS prcp_14d,
           SUM(p) {back(30)} AS prcp_30d, MAX(p) {back(7)} AS prcp_max_7d,
           MAX(windspeed_mph) {back(7)} AS wind_max_7d, MAX(saturation_pct) {back(7)} AS saturation_max_7d,
           MAX(pressure_hpa) {back(3)} - pressure_hpa AS pressure_drop_3d,
           soil_moisture_vol - AVG(soil_moisture_vol) {back(30)} AS soil_moisture_anom_30d,
           tavg - AVG(tavg) {back(7)} AS temp_anom_7d, tavg - AVG(tavg) {back(30)} AS temp_anom,
           p - AVG(p) {back(30)} AS prcp_anom, AVG(p) {back(30)} AS m,
           prcp * (saturation_pct / 100) AS flood_risk_idx,
           windspeed_mph * (1013.25::DOUBLE / CASE WHEN pressure_hpa < 900 THEN 900 ELSE pressure_hpa END) AS wind_risk_idx
    FROM filled"""

DRIED = """
    SELECT *, CASE WHEN AVG(m) OVER (PARTITION BY station) - m < 0 THEN 0
                   ELSE AVG(m) OVER (PARTITION BY station) - m END AS drought_idx
    FROM windowed"""

LIMITS = """
    SELECT station, QUANTILE_CONT(tavg, 0.95) AS t95, QUANTILE_CONT(tavg, 0.05) AS t05,
           QUANTILE_CONT(drought_idx, 0.75) AS drought75, QUANTILE_CONT(flood_risk_idx, 0.90) AS flood90,
           QUANTILE_CONT(wind_risk_idx, 0.90) AS wind90
    FROM dried GROUP BY 1"""

STATE = """
    SELECT x.*, t95, t05, drought75, flood90, wind90,
           CASE WHEN COALESCE(tavg > t95, FALSE) THEN 1 ELSE 0 END AS extreme_heat,
           CASE WHEN COALESCE(tavg < t05, FALSE) THEN 1 ELSE 0 END AS extreme_cold,
           CASE WHEN COALESCE(tavg > t95, FALSE) OR COALESCE(drought_idx > drought75, FALSE)
                  OR COALESCE(flood_risk_idx > flood90, FALSE) OR COALESCE(wind_risk_idx > wind90, FALSE)
                THEN 1 ELSE 0 END AS current_risk,
           CASE WHEN dew >= 0 THEN POW(dew, 1.5) END AS dew15,
           CASE WHEN dew + 8.313659 >= 0 THEN SQRT(dew + 8.313659::DOUBLE) END AS dew_root
    FROM dried x JOIN limits USING (station)"""

PHYSICS = """
    SELECT *,
        -8.78469475556::DOUBLE + 1.61139411::DOUBLE * tavg + 2.33854883889::DOUBLE * dew
            - 0.14611605::DOUBLE * tavg * dew - 0.012308094::DOUBLE * tavg * tavg - 0.016424828::DOUBLE * dew * dew
            + 0.002211732::DOUBLE * tavg * tavg * dew + 0.00072546::DOUBLE * tavg * dew * dew
            - 0.000003582::DOUBLE * tavg * tavg * dew * dew AS heat_index,
        13.12::DOUBLE + 0.6215::DOUBLE * tavg - 11.37::DOUBLE * POW(kmh, 0.16)
            + 0.3965::DOUBLE * tavg * POW(kmh, 0.16) AS wind_chill,
        tavg * ATAN(0.151977::DOUBLE * dew_root) + ATAN(tavg + dew) - ATAN(dew - 1.676331::DOUBLE)
            + 0.00391838::DOUBLE * dew15 * ATAN(0.023101::DOUBLE * dew) - 4.686035::DOUBLE AS wet_bulb,
        tavg - sst AS sst_air_diff,
        LEAD(current_risk) OVER (PARTITION BY station ORDER BY d) AS risk_engineered
    FROM state"""

TARGET = """
    SELECT *, CASE WHEN event_label_available <> 0 AND event_label IS NOT NULL THEN event_label
                   ELSE risk_engineered END AS risk
    FROM physics"""

STEPS = {
    "basins": BASINS, "placed": PLACED, "joined": JOINED, "assembled": ASSEMBLED, "filled": FILLED,
    "windowed": WINDOWED, "dried": DRIED, "limits": LIMITS, "state": STATE, "physics": PHYSICS, "target": TARGET,
}
SOURCES = "obs day atm soil idx sst stations lab dlab"


def upto(step: str) -> dict[str, str]:
    names = list(STEPS)
    return {n: STEPS[n] for n in names[: names.index(step) + 1]}
