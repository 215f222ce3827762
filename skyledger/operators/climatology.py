"""Aggregates behind the dashboards and the evidence report."""

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.columns import fahrenheit_to_celsius
from skyledger.operators.chunks import join_by_station
from skyledger.operators.target import station_quantiles
from skyledger.schema import BASINS, DAY, INDICES, STATION


def monthly_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(STATION, F.date_format(DAY, "yyyy-MM").alias("month")).agg(
        F.round(F.avg("TMAX"), 1).alias("avg_max_temp"),
        F.round(F.avg("TMIN"), 1).alias("avg_min_temp"),
        F.round(F.max("TMAX"), 1).alias("peak_temp"),
        F.round(F.coalesce(F.sum("PRCP"), F.lit(0.0)), 1).alias("total_rainfall"),
        F.count_if(F.col("PRCP") > 0.1).alias("rainy_days"),
    )


def window_kpis(df: DataFrame) -> DataFrame:
    rainy = F.count_if(F.col("PRCP") > 0.1)
    return df.groupBy(STATION).agg(
        ((F.avg("TMAX") + F.avg("TMIN")) / 2).alias("avg_temp"),
        F.max("TMAX").alias("peak_temp"),
        F.min("TMIN").alias("min_temp"),
        F.coalesce(F.sum("PRCP"), F.lit(0.0)).alias("total_rain"),
        F.max("PRCP").alias("max_daily_rain"),
        rainy.alias("rainy_days"),
        (rainy * 100.0 / F.count(F.lit(1))).alias("rainy_pct"),
    )


def annual_summary(df: DataFrame) -> DataFrame:
    """Per station and calendar year; a year without rows has null mean and zero rain."""
    yearly = df.groupBy(STATION, F.year(DAY).alias("year")).agg(
        F.avg("TAVG").alias("tavg"), F.sum("PRCP").alias("prcp")
    )
    return calendar_years(yearly).withColumn("prcp", F.coalesce("prcp", F.lit(0.0)))


def calendar_years(yearly: DataFrame) -> DataFrame:
    span = yearly.groupBy(STATION).agg(F.sequence(F.min("year"), F.max("year")).alias("_y"))
    return span.select(STATION, F.explode("_y").alias("year")).join(yearly, [STATION, "year"], "left")


def station_kpis(df: DataFrame) -> DataFrame:
    """Rows, mean temperature, mean annual rain and maximum daily rain, from one aggregation by year."""
    yearly = df.groupBy(STATION, F.year(DAY).alias("year")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("TAVG").alias("_t"), F.count("TAVG").alias("_c"),
        F.sum("PRCP").alias("_p"), F.max("PRCP").alias("_m"),
    )
    years = F.max("year") - F.min("year") + 1
    return yearly.groupBy(STATION).agg(
        F.sum("_n").alias("rows"),
        F.try_divide(F.sum("_t"), F.sum("_c")).alias("mean_tavg"),
        (F.coalesce(F.sum("_p"), F.lit(0.0)) / years).alias("mean_annual_prcp"),
        F.max("_m").alias("max_daily_prcp"),
    )


def sst_long(sst: DataFrame) -> DataFrame:
    known = [c for c in BASINS if c in sst.columns]
    label = F.initcap(F.regexp_replace(F.regexp_replace("_name", "^sst_", ""), "_f$", ""))
    return sst.unpivot(DAY, known, "_name", "_f").select(
        DAY, label.alias("basin"), fahrenheit_to_celsius(F.col("_f")).alias("celsius")
    )


def annual_sst(sst: DataFrame) -> DataFrame:
    return sst_long(sst).groupBy(F.year(DAY).alias("year"), "basin").agg(F.avg("celsius").alias("sst"))


def monthly_indices(indices: DataFrame) -> DataFrame:
    """Month-end means on a complete run of months."""
    names = [c for c in INDICES if c in indices.columns]
    monthly = indices.groupBy(F.last_day(DAY).alias("month_end")).agg(*[F.avg(c).alias(c) for c in names])
    first, last = F.trunc(F.min("month_end"), "month"), F.trunc(F.max("month_end"), "month")
    months = F.sequence(first, last, F.expr("interval 1 month"))
    spine = monthly.agg(F.transform(months, F.last_day).alias("_m")).select(F.explode("_m").alias("month_end"))
    return spine.join(monthly, "month_end", "left")


def seasonal_climatology(df: DataFrame) -> DataFrame:
    return df.groupBy(STATION, F.month(DAY).alias("month")).agg(
        F.avg("TAVG").alias("mean_tavg"), F.avg("PRCP").alias("mean_daily_prcp")
    )


def trend_per_decade(annual: DataFrame) -> DataFrame:
    """Slope of the annual mean against the year's position, times ten."""
    slope = F.regr_slope("tavg", F.col("year").cast("double")) * 10
    return annual.groupBy(STATION).agg(slope.alias("trend_per_decade"))


def trend_line(annual: DataFrame) -> DataFrame:
    """Least-squares line of the annual mean against the calendar year, with its fitted values."""
    x = F.col("year").cast("double")
    line = annual.groupBy(STATION).agg(
        F.regr_slope("tavg", x).alias("slope"), F.regr_intercept("tavg", x).alias("intercept")
    )
    fitted = F.col("intercept") + F.col("slope") * F.col("year")
    return annual.join(line, STATION).select(STATION, "year", "tavg", "slope", fitted.alias("fitted"))


def station_profile(df: DataFrame) -> DataFrame:
    facts = df.groupBy(STATION).agg(
        F.count(F.lit(1)).alias("rows"),
        F.date_format(F.min(DAY), "yyyy-MM-dd").alias("start"),
        F.date_format(F.max(DAY), "yyyy-MM-dd").alias("end"),
        F.round(F.avg("TAVG"), 3).alias("mean_tavg_c"),
        F.round(F.max("PRCP"), 3).alias("max_daily_prcp_mm"),
    )
    annual = annual_summary(df)
    yearly = annual.groupBy(STATION).agg(
        F.round(F.avg("prcp"), 3).alias("mean_annual_prcp_mm"),
        F.round(F.regr_slope("tavg", F.col("year").cast("double")) * 10, 4).alias("temperature_trend_c_per_decade"),
    )
    return facts.join(yearly, STATION)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are known; null without such rows.

    One scan and one aggregation: a row goes to a group for each column, which correlates it with the columns from it
    on. A single group for all pairs would generate methods too large to be compiled.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = values.select(*columns, F.posexplode(F.array(*columns)).alias("_at", "_value"))
    wide = long.groupBy("_at").agg(*[F.corr("_value", F.when(F.col("_at") <= j, F.col(y))).alias(y) for j, y in enumerate(columns)])
    names = F.array(*[F.lit(c) for c in columns])
    pairs = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("_at")).join(wide, "_at", "left")
    found = pairs.unpivot(["_at"], columns, "y", "corr").filter(F.array_position(names, F.col("y")) > F.col("_at")).select(
        F.element_at(names, F.col("_at") + 1).alias("x"), "y", "corr")
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    sides = F.when(F.col("x") == F.col("y"), F.slice(both, 1, 1)).otherwise(both)
    return found.select(F.explode(sides).alias("p"), "corr").select("p.x", "p.y", "corr")


def hazard_shares(df: DataFrame) -> DataFrame:
    """Share of rows above the station's own hot and wet limits, and of dry rows; null counts as no."""
    placed = join_by_station(df, station_quantiles(df, {"_t95": ("TAVG", 0.95), "_p90": ("PRCP", 0.90)}))

    def share(condition):
        return F.avg(F.coalesce(condition, F.lit(False)).cast("double")) * 100

    return placed.groupBy(STATION).agg(
        share(F.col("TAVG") > F.col("_t95")).alias("extreme_heat_pct"),
        share(F.col("PRCP") > F.col("_p90")).alias("heavy_prcp_pct"),
        share(F.col("PRCP") < 0.1).alias("dry_pct"),
    )


def sst_kpis(sst: DataFrame) -> DataFrame:
    return sst_long(sst).groupBy("basin").agg(
        F.max_by("celsius", DAY).alias("latest"),
        F.date_format(F.max(DAY), "yyyy-MM-dd").alias("latest_date"),
        F.avg("celsius").alias("mean"),
        F.max("celsius").alias("peak"),
    )


def split_manifest(df: DataFrame) -> DataFrame:
    """Rows, period, stations and labelled rows per split."""
    available = F.col("EVENT_LABEL_AVAILABLE") if "EVENT_LABEL_AVAILABLE" in df.columns else F.lit(0)
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.date_format(F.min(DAY), "yyyy-MM-dd").alias("start"),
        F.date_format(F.max(DAY), "yyyy-MM-dd").alias("end"),
        F.countDistinct(STATION).alias("stations"),
        F.sum(F.coalesce(available, F.lit(0))).cast("long").alias("labelled_rows"),
    )


def distinct_stations(df: DataFrame, prefix: str = "USW") -> DataFrame:
    return df.filter(F.col(STATION).startswith(prefix)).agg(F.countDistinct(STATION).alias("stations"))


def coverage_check(aux: DataFrame, start: str, end: str) -> DataFrame:
    """Does the auxiliary series span the study period?"""
    return aux.agg(F.min(DAY).alias("first"), F.max(DAY).alias("last")).withColumn(
        "covers", (F.col("first") <= F.to_date(F.lit(start))) & (F.col("last") >= F.to_date(F.lit(end)))
    )


def completeness_check(df: DataFrame, required: list[str]) -> DataFrame:
    """Nulls per required column; an absent column counts as null in every row."""
    counts = [
        (F.count_if(F.col(c).isNull()) if c in df.columns else F.count(F.lit(1))).alias(c) for c in required
    ]
    wide = df.agg(*counts)
    return wide.unpivot([], required, "name", "nulls")


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
