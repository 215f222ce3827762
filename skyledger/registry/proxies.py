"""Station data derived from the test tables, as DataFrames and as SQL views of the same content.

A station is a supplier, so the panel grows with the tables. Values are whole numbers or binary
fractions, so that sums do not depend on their order.
"""

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.operators.lineage import settle
from skyledger.schema import DAY, STATION


#: Moves that leave gaps in a source without leaving out rows of its table.
FAR_STATIONS, FAR_DAYS, LABEL_DAYS = 1_000_000, 14_610, 2_922
_archive: dict[tuple, DataFrame] = {}


def archived(build):
    """Derive the whole table once per session and folder, as a written archive.

    The queries then start from station files, as they do in production, and the planner knows the
    archive's true size.
    """

    @functools.wraps(build)
    def table(self):
        key = (self.spark.sparkContext.applicationId, self.folder, build.__name__)
        if key not in _archive:
            _archive[key] = settle(build(self), build.__name__)
        return _archive[key]

    return table


class Tables:
    """The given tables and the station archive that derives from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, f"table {name}")
        if key not in _archive:
            _archive[key] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return _archive[key]

    @staticmethod
    def station_id(key: Column) -> Column:
        prefix = F.when(key % 10 == 3, F.lit("USC")).otherwise(F.lit("USW"))
        return F.concat(prefix, F.lpad(key.cast("string"), 8, "0"))

    @archived
    def obs(self) -> DataFrame:
        lines = self.read("lineitem")
        daily = lines.groupBy("l_suppkey", F.to_date("l_shipdate").alias(DAY)).agg(
            F.when(F.max("l_orderkey") % 29 != 0, F.max("l_quantity")).alias("TMAX"),
            (F.min("l_quantity") - 15 - F.min("l_linenumber") % 7).alias("TMIN"),
            F.when(F.max("l_orderkey") % 17 != 0, F.sum(F.round(F.col("l_tax") * 100).cast("int")) / 2.0).alias("PRCP"),
        )
        return self.by_station(daily)

    def by_station(self, daily: DataFrame) -> DataFrame:
        """Station ids only after the aggregation, which then hashes numbers."""
        rest = [c for c in daily.columns if c != "l_suppkey"]
        return daily.select(self.station_id(F.col("l_suppkey")).alias(STATION), *rest)

    def stations(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.read("supplier").select(
            self.station_id(key).alias("station_id"), F.col("s_name").alias("name"),
            F.concat(F.lit("region "), F.col("s_nationkey")).alias("region"),
            F.when(F.col("s_nationkey") % 3 != 0, F.lit("humid")).alias("climate"),
            (key * 37 % 1500).cast("double").alias("elevation"),
            (F.lit(25.0) + (key * 7919 % 2500) / 100.0).alias("lat"),
            (F.lit(-125.0) + (key * 104729 % 5800) / 100.0).alias("lon"),
            F.when(key % 4 == 0, F.lit("sst_gulf_f")).alias("ocean_basin"),
        )

    def lines(self, every: int) -> DataFrame:
        """All line items; one supplier in ``every`` is moved to a station that the archive lacks."""
        key = F.col("l_suppkey")
        return self.read("lineitem").withColumn("l_suppkey", F.when(key % every == 0, key + FAR_STATIONS).otherwise(key))

    def orders_until(self, day: int) -> DataFrame:
        """All orders by day; the later days of each month are moved ``FAR_DAYS`` back, to leave gaps."""
        date = F.to_date("o_orderdate")
        moved = F.when(F.dayofmonth("o_orderdate") > day, F.date_sub(date, FAR_DAYS)).otherwise(date)
        return self.read("orders").withColumn("o_orderdate", moved)

    def _price(self) -> Column:
        return F.floor("l_extendedprice").cast("bigint")

    @archived
    def atmosphere(self) -> DataFrame:
        price = self._price()
        daily = self.lines(11).groupBy(
            "l_suppkey", F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") % 3).alias(DAY)
        ).agg(
            F.max(F.when(price % 13 != 0, price % 90)).cast("double").alias("DEWPOINT_F"),
            F.max(price % 40).cast("double").alias("WINDSPEED_MPH"),
            F.max(F.when(price % 7 != 0, price % 160 + 880)).cast("double").alias("PRESSURE_HPA"),
            F.max(price % 101).cast("double").alias("HUMIDITY_PCT"),
            F.max(price % 2).cast("double").alias("ATMOSPHERE_IMPUTED"),
            F.max(price % 2 * (price % 64)).cast("double").alias("ATMOSPHERE_DONOR_KM"),
        )
        return self.by_station(daily)

    @archived
    def soil(self) -> DataFrame:
        price = self._price()
        daily = self.lines(7).groupBy(
            "l_suppkey", F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") % 2).alias(DAY)
        ).agg(
            (F.max(F.when(price % 5 != 0, price % 60)) / 128.0).alias("SOIL_MOISTURE_VOL"),
            F.max(F.when(price % 5 != 0, price % 101)).cast("double").alias("SATURATION_PCT"),
        )
        return self.by_station(daily)

    @archived
    def indices(self) -> DataFrame:
        n = F.count(F.lit(1))
        return self.orders_until(15).groupBy(F.col("o_orderdate").alias(DAY)).agg(
            F.when(n % 3 != 0, n / 8.0).alias("enso_nino34"),
            (F.min("o_orderkey") % 7 - 3).cast("double").alias("pdo_index"),
            F.when(F.max("o_orderkey") % 5 != 0, (F.max("o_orderkey") % 9 - 4) / 4.0).alias("nao_index"),
        )

    @archived
    def sst(self) -> DataFrame:
        return self.orders_until(20).groupBy(F.col("o_orderdate").alias(DAY)).agg(
            (F.min("o_orderkey") % 20 + 50).cast("double").alias("sst_pacific_f"),
            F.when(F.max("o_orderkey") % 11 != 0, F.max("o_orderkey") % 20 + 55).cast("double").alias("sst_atlantic_f"),
            (F.count(F.lit(1)) % 20 + 70).cast("double").alias("sst_gulf_f"),
        )

    def raw_labels(self) -> DataFrame:
        key, day = F.col("l_orderkey"), F.to_date("l_shipdate")
        # Labels start in 2000: the days before it follow eight years later.
        day = F.when(day < F.lit("2000-01-01").cast("date"), F.date_add(day, LABEL_DAYS)).otherwise(day)
        return self.lines(5).select(
            F.when(key % 97 == 0, F.lit("no date")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("date"),
            F.lower(self.station_id(F.col("l_suppkey"))).alias("NOAA_STATION"),
            F.when(key % 31 == 0, F.lit("?")).when(F.col("l_returnflag") == "R", F.lit("1")).otherwise(F.lit("0")).alias(
                "EVENT_LABEL"
            ),
            F.when(key % 6 != 0, F.concat(F.lit("type "), "l_linestatus", F.col("l_linenumber") % 3)).alias("EVENT_TYPE"),
            F.when(key % 19 == 0, F.lit("far")).otherwise((F.col("l_linenumber") * 10).cast("string")).alias(
                "EVENT_DISTANCE_KM"
            ),
        )

    def labels(self) -> DataFrame:
        from skyledger.operators.enrichment import clean_labels

        return clean_labels(self.raw_labels())

    def chips(self) -> DataFrame:
        return self.read("events").filter("event_type = 'view'").select(
            F.col("event_id").alias("chip_id"), self.station_id(F.col("user_id")).alias(STATION), "ts",
            F.col("value").alias("intensity"),
        )

    def storms(self) -> DataFrame:
        user, event = F.col("user_id"), F.col("event_id")
        return self.read("events").filter("event_type = 'error'").select(
            event.alias("storm_id"), self.station_id(user).alias(STATION), "ts", F.to_date("ts").alias(DAY),
            (F.lit(25.0) + (user * 7919 % 2500) / 100.0 + (event % 10) / 10.0).alias("lat"),
            (F.lit(-125.0) + (user * 104729 % 5800) / 100.0 + (event % 7) / 10.0).alias("lon"),
            F.concat(F.lit("kind "), event % 4).alias("event_type"),
        )

    def scores(self) -> DataFrame:
        fine = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 10007 / 16384.0
        hit = F.col("l_returnflag") == "R"
        return self.read("lineitem").select(
            F.col("l_linestatus").alias("part"), hit.cast("int").alias("y"),
            F.round(F.col("l_discount") * 10, 6).alias("tied"),
            (fine + F.when(hit, 0.25).otherwise(0.0)).alias("score"),
        )

    def grids(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("index"), F.array("embedding").alias("grid"), (F.col("label") % 3 - 1).alias("label")
        )


ID = "CASE WHEN {k} % 10 = 3 THEN 'USC' ELSE 'USW' END || LPAD(CAST({k} AS VARCHAR), 8, '0')"
SUPPLIER_ID, USER_ID = ID.format(k="l_suppkey"), ID.format(k="user_id")
PRICE = "CAST(FLOOR(l_extendedprice) AS BIGINT)"


def lines(every: int) -> str:
    moved = f"CASE WHEN l_suppkey % {every} = 0 THEN l_suppkey + {FAR_STATIONS} ELSE l_suppkey END"
    return f"(SELECT * REPLACE ({moved} AS l_suppkey) FROM lineitem)"


def orders_until(day: int) -> str:
    date = "CAST(o_orderdate AS DATE)"
    return f"(SELECT o_orderkey, CASE WHEN DAY(o_orderdate) > {day} THEN {date} - {FAR_DAYS} ELSE {date} END AS o_orderdate FROM orders)"


VIEWS = {
    "obs": f"""
        SELECT {SUPPLIER_ID} AS station, CAST(l_shipdate AS DATE) AS d,
               CASE WHEN MAX(l_orderkey) % 29 <> 0 THEN MAX(l_quantity) END AS tmax,
               MIN(l_quantity) - 15 - MIN(l_linenumber) % 7 AS tmin,
               CASE WHEN MAX(l_orderkey) % 17 <> 0
                    THEN CAST(SUM(CAST(ROUND(l_tax * 100) AS INTEGER)) AS DOUBLE) / 2 END AS prcp
        FROM lineitem GROUP BY 1, 2""",
    "day": "SELECT *, (tmax + tmin) / 2 AS tavg, COALESCE(prcp, 0) AS p FROM obs",
    "stations": f"""
        SELECT {ID.format(k="s_suppkey")} AS station, s_name AS name, 'region ' || s_nationkey AS region,
               CASE WHEN s_nationkey % 3 <> 0 THEN 'humid' END AS climate,
               CAST(s_suppkey * 37 % 1500 AS DOUBLE) AS elevation,
               CAST(25 AS DOUBLE) + CAST(s_suppkey * 7919 % 2500 AS DOUBLE) / 100 AS lat,
               CAST(-125 AS DOUBLE) + CAST(s_suppkey * 104729 % 5800 AS DOUBLE) / 100 AS lon,
               CASE WHEN s_suppkey % 4 = 0 THEN 'sst_gulf_f' END AS ocean_basin
        FROM supplier""",
    "atm": f"""
        SELECT {SUPPLIER_ID} AS station, CAST(l_shipdate AS DATE) + CAST(l_linenumber % 3 AS INTEGER) AS d,
               CAST(MAX(CASE WHEN {PRICE} % 13 <> 0 THEN {PRICE} % 90 END) AS DOUBLE) AS dewpoint_f,
               CAST(MAX({PRICE} % 40) AS DOUBLE) AS windspeed_mph,
               CAST(MAX(CASE WHEN {PRICE} % 7 <> 0 THEN {PRICE} % 160 + 880 END) AS DOUBLE) AS pressure_hpa,
               CAST(MAX({PRICE} % 101) AS DOUBLE) AS humidity_pct,
               CAST(MAX({PRICE} % 2) AS DOUBLE) AS atmosphere_imputed,
               CAST(MAX({PRICE} % 2 * ({PRICE} % 64)) AS DOUBLE) AS atmosphere_donor_km
        FROM {lines(11)} GROUP BY 1, 2""",
    "soil": f"""
        SELECT {SUPPLIER_ID} AS station, CAST(l_shipdate AS DATE) + CAST(l_linenumber % 2 AS INTEGER) AS d,
               CAST(MAX(CASE WHEN {PRICE} % 5 <> 0 THEN {PRICE} % 60 END) AS DOUBLE) / 128 AS soil_moisture_vol,
               CAST(MAX(CASE WHEN {PRICE} % 5 <> 0 THEN {PRICE} % 101 END) AS DOUBLE) AS saturation_pct
        FROM {lines(7)} GROUP BY 1, 2""",
    "idx": f"""
        SELECT o_orderdate AS d,
               CASE WHEN COUNT(*) % 3 <> 0 THEN CAST(COUNT(*) AS DOUBLE) / 8 END AS enso_nino34,
               CAST(MIN(o_orderkey) % 7 - 3 AS DOUBLE) AS pdo_index,
               CASE WHEN MAX(o_orderkey) % 5 <> 0
                    THEN CAST(MAX(o_orderkey) % 9 - 4 AS DOUBLE) / 4 END AS nao_index
        FROM {orders_until(15)} GROUP BY 1""",
    "sst": f"""
        SELECT o_orderdate AS d,
               CAST(MIN(o_orderkey) % 20 + 50 AS DOUBLE) AS sst_pacific_f,
               CAST(CASE WHEN MAX(o_orderkey) % 11 <> 0 THEN MAX(o_orderkey) % 20 + 55 END AS DOUBLE) AS sst_atlantic_f,
               CAST(COUNT(*) % 20 + 70 AS DOUBLE) AS sst_gulf_f
        FROM {orders_until(20)} GROUP BY 1""",
    "rawlab": f"""
        SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'no date' ELSE strftime(
                 CAST(l_shipdate AS DATE) + CASE WHEN CAST(l_shipdate AS DATE) < DATE '2000-01-01' THEN {LABEL_DAYS} ELSE 0 END,
                 '%Y-%m-%d') END AS date,
               LOWER({SUPPLIER_ID}) AS noaa_station,
               CASE WHEN l_orderkey % 31 = 0 THEN '?' WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS event_label,
               CASE WHEN l_orderkey % 6 <> 0 THEN 'type ' || l_linestatus || l_linenumber % 3 END AS event_type,
               CASE WHEN l_orderkey % 19 = 0 THEN 'far' ELSE CAST(l_linenumber * 10 AS VARCHAR) END AS event_distance_km
        FROM {lines(5)}""",
    "lab": """
        SELECT TRY_CAST(date AS DATE) AS d, UPPER(noaa_station) AS station,
               COALESCE(TRY_CAST(event_label AS INTEGER), 0) AS event_label, event_type,
               TRY_CAST(event_distance_km AS DOUBLE) AS event_distance_km
        FROM rawlab WHERE TRY_CAST(date AS DATE) IS NOT NULL""",
    "dlab": """
        SELECT d, station, MAX(event_label) AS event_label,
               COALESCE(STRING_AGG(DISTINCT event_type, '; ' ORDER BY event_type), '') AS event_type,
               MIN(event_distance_km) AS event_distance_km
        FROM lab GROUP BY 1, 2""",
    "chips": f"""
        SELECT event_id AS chip_id, {USER_ID} AS station, ts, value AS intensity FROM events WHERE event_type = 'view'""",
    "storms": f"""
        SELECT event_id AS storm_id, {USER_ID} AS station, ts, CAST(ts AS DATE) AS d,
               CAST(25 AS DOUBLE) + CAST(user_id * 7919 % 2500 AS DOUBLE) / 100 + CAST(event_id % 10 AS DOUBLE) / 10 AS lat,
               CAST(-125 AS DOUBLE) + CAST(user_id * 104729 % 5800 AS DOUBLE) / 100
                   + CAST(event_id % 7 AS DOUBLE) / 10 AS lon,
               'kind ' || event_id % 4 AS event_type
        FROM events WHERE event_type = 'error'""",
    "scores": """
        SELECT l_linestatus AS part, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
               ROUND(l_discount * 10, 6) AS tied,
               CAST((l_orderkey * 7919 + l_linenumber * 104729) % 10007 AS DOUBLE) / 16384
                   + CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) / 4 ELSE 0 END AS score
        FROM lineitem""",
    "grids": "SELECT vec_id AS index, embedding, label % 3 - 1 AS label FROM embeddings",
}
NEEDS = {"day": ["obs"], "lab": ["rawlab"], "dlab": ["lab"]}


def over(views: str, statement: str, **extra: str) -> str:
    """The statement behind the views it names; ``extra`` adds further views in order."""
    order: list[str] = []

    def need(name: str) -> None:
        for inner in NEEDS.get(name, []):
            need(inner)
        if name not in order:
            order.append(name)

    for name in views.split():
        need(name)
    parts = [f"fx_{n} AS ({VIEWS[n]})" for n in order]
    text = ",\n".join(parts)
    extras = [f"{n} AS ({sql})" for n, sql in extra.items()]
    body = ",\n".join([text, *extras]) if extras else text
    for name in order:
        body = prefixed(body, name)
        statement = prefixed(statement, name)
    return f"WITH {body}\n-- statement\n{statement}"


def prefixed(sql: str, name: str) -> str:
    """View names are written plainly and carry ``fx_`` in the final text."""
    import re

    return re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 fx_{name}", sql)
