

import pytest
from pyspark.sql import functions as F

from skyledger.functions import hazards as H
from skyledger.functions.columns import display_name, flag, floor_at, row_mean


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).cast("double" if not isinstance(v, str) else "string").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_floor_keeps_null(spark):
    assert one(spark, floor_at(F.col("a"), 0.0), a=None) is None
    assert one(spark, floor_at(F.col("a"), 0.0), a=-3.0) == 0.0


def test_flag_counts_unknown_as_zero(spark):
    assert one(spark, flag(F.col("a") > 1), a=None) == 0


def test_wet_bulb_branches(spark):
    wet = lambda mode, d: one(spark, H.wet_bulb(F.col("t"), F.col("d"), mode), t=10.0, d=d)
    assert wet("training", -5.0) is None
    assert wet("scoring", -5.0) is not None
    assert wet("scoring", -10.0) is None
    assert wet("training", 4.0) == pytest.approx(wet("scoring", 4.0))


def test_wind_risk_floors_pressure(spark):
    assert one(spark, H.wind_risk(F.col("w"), F.col("p")), w=10.0, p=850.0) == pytest.approx(10 * 1013.25 / 900)


def test_heat_index_by_hand(spark):
    t, d = 30.0, 20.0
    expected = (-8.78469475556 + 1.61139411 * t + 2.33854883889 * d - 0.14611605 * t * d - 0.012308094 * t * t
                - 0.016424828 * d * d + 0.002211732 * t * t * d + 0.00072546 * t * d * d - 0.000003582 * t * t * d * d)
    assert one(spark, H.heat_index(F.col("t"), F.col("d")), t=t, d=d) == pytest.approx(expected)


def test_wind_chill_by_hand(spark):
    gust = 20.0 ** 0.16
    expected = 13.12 + 0.6215 * 5 - 11.37 * gust + 0.3965 * 5 * gust
    assert one(spark, H.wind_chill(F.col("t"), F.col("w")), t=5.0, w=20.0) == pytest.approx(expected)


@pytest.mark.parametrize("pct,tier", [
    (-5, "Low Risk"), (29.99, "Low Risk"), (30, "Moderate Alert"), (60, "Severe Warning"), (85, "Extreme Danger"),
    (140, "Extreme Danger"),
])
def test_risk_tiers(spark, pct, tier):
    assert one(spark, H.risk_tier(F.col("p")), p=float(pct)) == tier


@pytest.mark.parametrize("station,lat,lon,basin", [
    ("phoenix", 47.0, -122.0, "sst_gulf_f"), ("X", 47.0, -122.0, "sst_pacific_f"), ("X", 30.0, -90.0, "sst_gulf_f"),
    ("X", 40.0, -74.0, "sst_atlantic_f"), ("X", None, -74.0, None),
])
def test_ocean_basin(spark, station, lat, lon, basin):
    assert one(spark, H.ocean_basin(F.col("s"), F.col("a"), F.col("o")), s=station, a=lat, o=lon) == basin


def test_hybrid_risk_prefers_covered_labels(spark):
    risk = lambda label, available: one(
        spark, H.hybrid_risk(F.col("p"), F.col("l"), F.col("a")), p=1.0, l=label, a=available
    )
    assert risk(0.0, 1.0) == 0.0
    assert risk(0.0, 0.0) == 1.0
    assert risk(None, 1.0) == 1.0


def test_row_mean_skips_nulls(spark):
    assert one(spark, row_mean(["a", "b", "c"]), a=1.0, b=None, c=4.0) == 2.5
    assert one(spark, row_mean(["a", "b"]), a=None, b=None) is None


def test_display_name(spark):
    assert one(spark, display_name(F.col("c")), c="NEW_YORK") == "New York (NEW_YORK)"


def test_chip_category(spark):
    kind = lambda p, r: one(spark, H.chip_category(F.col("p"), F.col("r")), p=p, r=r)
    assert [kind(0.6, 0.0), kind(0.1, 0.0), kind(0.1, 0.14), kind(0.4, 0.31)] == [
        "Severe Storm", "Clear Sky", "Light Rain", "Convective Activity",
    ]
