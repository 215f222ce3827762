"""Physical indices and risk rules as Spark column expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F

from skyledger.functions.columns import flag, floor_at, no_nan
from skyledger.schema import BASIN_BY_STATION

# Heat-index polynomial as (coefficient, power of T, power of D), both in Celsius.
HEAT_INDEX_TERMS = [
    (-8.78469475556, 0, 0),
    (1.61139411, 1, 0),
    (2.33854883889, 0, 1),
    (-0.14611605, 1, 1),
    (-0.012308094, 2, 0),
    (-0.016424828, 0, 2),
    (0.002211732, 2, 1),
    (0.00072546, 1, 2),
    (-0.000003582, 2, 2),
]

# Wind chill (km/h) and wet-bulb coefficients.
WIND_CHILL_TERMS = (13.12, 0.6215, -11.37, 0.3965)
WIND_CHILL_POWER = 0.16
WET_BULB_ROOT = (0.151977, 8.313659)
WET_BULB_SHIFT = 1.676331
WET_BULB_TAIL = (0.00391838, 0.023101)
WET_BULB_OFFSET = -4.686035

# Risk tiers as (upper bound of the percentage, name).
RISK_TIERS = [(30.0, "Low Risk"), (60.0, "Moderate Alert"), (85.0, "Severe Warning")]
TOP_TIER = "Extreme Danger"


def heat_index(temp: Column, dew: Column) -> Column:
    def term(coefficient: float, t_power: int, d_power: int) -> Column:
        return reduce(lambda a, b: a * b, [temp] * t_power + [dew] * d_power, F.lit(coefficient))

    return reduce(lambda a, b: a + b, [term(*t) for t in HEAT_INDEX_TERMS])


def wind_chill(temp: Column, wind_kmh: Column) -> Column:
    base, per_temp, per_wind, cross = WIND_CHILL_TERMS
    gust = no_nan(F.pow(wind_kmh, F.lit(WIND_CHILL_POWER)))
    return F.lit(base) + temp * per_temp + gust * per_wind + temp * gust * cross


def wet_bulb(temp: Column, dew: Column, mode: str = "training") -> Column:
    """Null below the root's domain; ``mode="scoring"`` clamps the 1.5 power at a dew point of 0."""
    scale, shift = WET_BULB_ROOT
    tail, tail_rate = WET_BULB_TAIL
    root = no_nan(F.sqrt(dew + shift))
    tail_base = floor_at(dew, 0.0) if mode == "scoring" else dew
    powered = no_nan(F.pow(tail_base, F.lit(1.5)))
    return (
        temp * F.atan(root * scale)
        + F.atan(temp + dew)
        - F.atan(dew - WET_BULB_SHIFT)
        + powered * tail * F.atan(dew * tail_rate)
        + WET_BULB_OFFSET
    )


def flood_risk(prcp: Column, saturation_pct: Column) -> Column:
    return prcp * (saturation_pct / 100.0)


def wind_risk(wind_mph: Column, pressure_hpa: Column) -> Column:
    return wind_mph * (F.lit(1013.25) / floor_at(pressure_hpa, 900.0))


def sst_air_diff(temp: Column, sst: Column) -> Column:
    return temp - sst


def extreme_heat(temp: Column, q95: Column) -> Column:
    return flag(temp > q95)


def extreme_cold(temp: Column, q05: Column) -> Column:
    return flag(temp < q05)


def current_risk(temp, drought, flood, wind, limits: dict[str, Column]) -> Column:
    """1.0 when any of the station's own thresholds is exceeded."""
    checks = [
        temp > limits["t95"],
        drought > limits["drought75"],
        flood > limits["flood90"],
        wind > limits["wind90"],
    ]
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in checks]).cast("double")


def hybrid_risk(proxy: Column, label: Column, available: Column) -> Column:
    """The reported-event label replaces the proxy where coverage exists."""
    return F.when((F.coalesce(available, F.lit(0)) != 0) & label.isNotNull(), label.cast("double")).otherwise(proxy)


def ocean_basin(station: Column, lat: Column, lon: Column) -> Column:
    """Basin column for a station; null when neither name nor coordinates decide."""
    named = F.create_map(*[F.lit(x) for pair in BASIN_BY_STATION.items() for x in pair])
    by_place = (
        F.when(lat.isNull() | lon.isNull(), F.lit(None).cast("string"))
        .when(lon <= -100.0, F.lit("sst_pacific_f"))
        .when((lat <= 31.5) & (lon <= -80.0), F.lit("sst_gulf_f"))
        .otherwise(F.lit("sst_atlantic_f"))
    )
    return F.coalesce(F.try_element_at(named, F.upper(station)), by_place)


def clamp_pct(pct: Column) -> Column:
    return F.when(pct < 0, F.lit(0.0)).when(pct > 100, F.lit(100.0)).otherwise(pct)


def risk_tier(pct: Column) -> Column:
    clamped = clamp_pct(pct)
    chain = F.when(clamped.isNull(), F.lit(None).cast("string"))
    for bound, name in RISK_TIERS:
        chain = chain.when(clamped < bound, F.lit(name))
    return chain.otherwise(F.lit(TOP_TIER))


def chip_category(probability: Column, reflectivity: Column, light_cut: float = 0.2) -> Column:
    return (
        F.when(probability >= 0.5, F.lit("Severe Storm"))
        .when(reflectivity == 0, F.lit("Clear Sky"))
        .when(reflectivity <= light_cut, F.lit("Light Rain"))
        .otherwise(F.lit("Convective Activity"))
    )


def chip_channel_max(grid: Column) -> Column:
    """Maximum of a two-dimensional channel."""
    return F.array_max(F.flatten(grid))
