"""Column names, feature list and fill values shared by every operator."""

from pyspark.sql import types as T

STATION = "City_ID"
DAY = "Date"

# The model's feature columns, in model order.
FEATURES = [
    "HEAT_INDEX", "WIND_CHILL", "WET_BULB", "DROUGHT_IDX",
    "TEMP_ANOM", "PRCP_ANOM", "EXTREME_HEAT", "EXTREME_COLD",
    "SST", "SST_AIR_DIFF", "FLOOD_RISK_IDX", "WIND_RISK_IDX",
    "PRESSURE_HPA", "HUMIDITY_PCT", "SOIL_MOISTURE_VOL", "SATURATION_PCT",
    "enso_nino34", "pdo_index", "nao_index",
    "LATITUDE", "LONGITUDE", "ELEVATION",
    "ATMOSPHERE_IMPUTED", "ATMOSPHERE_DONOR_KM",
    "SOIL_MOISTURE_OBSERVED", "CLIMATE_INDEX_OBSERVED",
    "PRCP_3D", "PRCP_7D", "PRCP_14D", "PRCP_30D", "PRCP_MAX_7D",
    "WIND_MAX_7D", "PRESSURE_DROP_3D", "SATURATION_MAX_7D",
    "SOIL_MOISTURE_ANOM_30D", "TEMP_ANOM_7D",
]

# Constant fills for missing measures (dew point is derived from TAVG).
CONSTANT_FILLS = {
    "WINDSPEED_MPH": 5.0,
    "PRESSURE_HPA": 1013.25,
    "HUMIDITY_PCT": 50.0,
    "SOIL_MOISTURE_VOL": 0.2,
    "SATURATION_PCT": 40.0,
    "enso_nino34": 0.0,
    "pdo_index": 0.0,
    "nao_index": 0.0,
    "ATMOSPHERE_IMPUTED": 0.0,
    "ATMOSPHERE_DONOR_KM": 0.0,
    "SOIL_MOISTURE_OBSERVED": 1.0,
    "CLIMATE_INDEX_OBSERVED": 1.0,
    "LATITUDE": 0.0,
    "LONGITUDE": 0.0,
    "ELEVATION": 0.0,
}
DEWPOINT_GAP_F = 15.0
SST_FILL_C = 18.0

ATMOSPHERE = [
    "DEWPOINT_F", "WINDSPEED_MPH", "PRESSURE_HPA", "HUMIDITY_PCT",
    "ATMOSPHERE_IMPUTED", "ATMOSPHERE_DONOR_KM",
]
SOIL = ["SOIL_MOISTURE_VOL", "SATURATION_PCT"]
INDICES = ["enso_nino34", "pdo_index", "nao_index"]
BASINS = ["sst_pacific_f", "sst_atlantic_f", "sst_gulf_f"]
SEQUENCE = ["TMAX", "TMIN", "TAVG", "PRCP", "SST"]

# Stations whose ocean basin is set by name.
BASIN_BY_STATION = {
    "SEATTLE": "sst_pacific_f",
    "KCQT": "sst_pacific_f",
    "NEW_YORK": "sst_atlantic_f",
    "KPHL": "sst_atlantic_f",
    "KJAX": "sst_atlantic_f",
    "KCLT": "sst_atlantic_f",
    "KHOU": "sst_gulf_f",
    "PHOENIX": "sst_gulf_f",
    "KIND": "sst_atlantic_f",
    "KMDW": "sst_atlantic_f",
}

# Lower-case aliases and raw columns that do not survive loading.
ALIASES = {
    "dewpoint_f": "DEWPOINT_F",
    "windspeed_mph": "WINDSPEED_MPH",
    "pressure_hpa": "PRESSURE_HPA",
    "humidity_pct": "HUMIDITY_PCT",
    "soil_moisture_vol": "SOIL_MOISTURE_VOL",
    "saturation_pct": "SATURATION_PCT",
}
RAW_COLUMNS = [
    "actual_max_temp", "actual_min_temp", "actual_precipitation",
    "average_max_temp", "average_min_temp",
    "record_max_temp", "record_min_temp",
    "record_max_temp_year", "record_min_temp_year",
    "record_precipitation", "date", "data_source",
]
RECORD_YEARS = {"record_max_temp_year": "REC_MAX_YR", "record_min_temp_year": "REC_MIN_YR"}

# Catalog entries for a station without metadata.
CATALOG_FILL = {
    "region": "U.S. Climatological Grid",
    "climate": "Local Microclimate",
    "elevation": 150.0,
    "lat": 39.8,
    "lon": -98.5,
    "ocean_basin": "sst_atlantic_f",
}
CATALOG_REGION = "NOAA Daily Station Network"
CATALOG_CLIMATE = "Station observations"
ARCHIVE_SOURCE = "NOAA Daily Station Archive"
LATEST_SUFFIX = " (latest available window)"

# Columns that must hold no null before training.
REQUIRED = [
    "TMAX", "TMIN", "PRCP", "DEWPOINT_F", "WINDSPEED_MPH", "PRESSURE_HPA",
    "HUMIDITY_PCT", "SOIL_MOISTURE_VOL", "SATURATION_PCT",
    "enso_nino34", "pdo_index", "nao_index",
    "ATMOSPHERE_IMPUTED", "SOIL_MOISTURE_OBSERVED", "CLIMATE_INDEX_OBSERVED",
]

TEXT_COLUMNS = {
    STATION, "date", "Date", "station_id", "name", "region", "climate", "ocean_basin",
    "csv_file", "NOAA_STATION", "EVENT_TYPE", "EVENT_LABEL", "EVENT_DISTANCE_KM",
    "timestamp", "category", "image_file", "data_source", "Source", "City_Name",
}

HEALTH_REPORT = T.StructType([
    T.StructField("unique_noaa_stations", T.LongType()),
    T.StructField("station_errors", T.LongType()),
    T.StructField("stations_training_ready", T.LongType()),
    T.StructField("stations", T.ArrayType(T.StructType([
        T.StructField("station_id", T.StringType()),
        T.StructField("training_ready", T.BooleanType()),
        T.StructField("core_completeness_pct", T.DoubleType()),
    ]))),
])

CHIP_ROW = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("max_reflectivity", T.DoubleType()),
    T.StructField("max_qpe", T.DoubleType()),
    T.StructField("max_shear", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("image_file", T.StringType()),
])
