"""The tables behind the evidence report, written side by side."""

from pyspark.sql import DataFrame

from skyledger.operators import climatology as K
from skyledger.operators.cleaning import derive_tavg
from skyledger.operators.enrichment import align_modalities


def evidence_tables(
    panel: DataFrame, atmosphere: DataFrame, indices: DataFrame, sst: DataFrame, correlated: list[str] | None = None
) -> dict[str, DataFrame]:
    """Name -> table, all lazy."""
    daily = derive_tavg(panel)
    annual = K.annual_summary(daily)
    aligned = align_modalities(daily, atmosphere, indices, sst)
    columns = correlated or [
        "TMAX", "TMIN", "TAVG", "PRCP", "DEWPOINT_F", "WINDSPEED_MPH", "PRESSURE_HPA", "HUMIDITY_PCT",
        "enso_nino34", "pdo_index", "nao_index", "sst_c",
    ]
    return {
        "station_profile": K.station_profile(daily),
        "annual": annual,
        "trend": K.trend_line(annual),
        "seasonal": K.seasonal_climatology(daily),
        "monthly": K.monthly_summary(daily),
        "sst_annual": K.annual_sst(sst),
        "sst_kpis": K.sst_kpis(sst),
        "indices_monthly": K.monthly_indices(indices),
        "correlation": K.correlation_matrix(aligned, [c for c in columns if c in aligned.columns]),
        "hazard_shares": K.hazard_shares(daily),
    }


def write_evidence(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{folder}/{name}")
