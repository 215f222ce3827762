"""The full feature panel with its target."""

from pyspark.sql import DataFrame, functions as F

from skyledger.operators.cleaning import fill_defaults, final_zero_fill
from skyledger.operators.lineage import settle
from skyledger.operators.rolling import panel_windows
from skyledger.operators.target import hazard_days, hazard_state, station_thresholds, weather_indices, with_target
from skyledger.schema import FEATURES


#: Features that need the thresholds of the station, or that its thresholds are taken from: no fill before those are known.
BY_STATION = ("DROUGHT_IDX", "EXTREME_HEAT", "EXTREME_COLD", "FLOOD_RISK_IDX", "WIND_RISK_IDX")


def as_double(df: DataFrame, names) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def hazard_panel(assembled: DataFrame, features: bool = False) -> DataFrame:
    """Window features, indices, flags and the next row's hazard state.

    The assembled panel and its windows are written once each: the branches of the window stage, the
    thresholds and the final join then read files instead of running the joins above again, and the
    thresholds' true size decides whether they are broadcast. With ``features`` those that need no
    threshold are finished before the windows are written: together with the others they make a
    generated method too long for the JVM to compile.
    """
    windows = panel_windows(settle(fill_defaults(assembled), "panel")).drop("_P")
    if features:
        early = [c for c in FEATURES if c not in BY_STATION]
        windows = as_double(weather_indices(windows), early).fillna(0, subset=early)
    windows = settle(windows, "windows")
    return hazard_state(windows, settle(station_thresholds(windows), "thresholds"))


def feature_panel(assembled: DataFrame, keep_open: bool = False) -> DataFrame:
    """36 features, ``RISK_ENGINEERED`` and ``RISK`` per station-day; ``keep_open`` keeps rows without a target."""
    panel = as_double(with_target(hazard_panel(assembled, features=True)), BY_STATION)
    return panel.fillna(0, subset=list(BY_STATION)) if keep_open else final_zero_fill(panel, BY_STATION)


def hazard_rates(assembled: DataFrame) -> DataFrame:
    """Share of hazardous days and of next-day targets per station."""
    return hazard_days(hazard_panel(assembled))
