"""Pooled training: split, scale, fit, fuse, evaluate; one job per model over all stations."""

from concurrent.futures import Future, ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from skyledger.functions.columns import flag
from skyledger.operators import learners as L
from skyledger.operators.enrichment import align_fusion_inputs
from skyledger.operators.lagged import LagModel, lagged_ridge
from skyledger.operators.lineage import owned_tables, settle
from skyledger.operators.metrics import (
    classification_metrics, event_subset_metrics, ranking_metrics, regression_metrics, tune_threshold,
)
from skyledger.operators.climatology import split_manifest
from skyledger.operators.rolling import sequences
from skyledger.operators.splits import (
    EVENT_TEST_FROM, EVENT_VALIDATION_FROM, MinMax, chronological_split, day_splits, event_readiness, event_split,
    minmax_fit, require_splits, with_splits,
)
from skyledger.schema import DAY, FEATURES, SEQUENCE, STATION

SEQUENCE_DAYS = 30

# Years of history that a station should have.
MINIMUM_YEARS, PREFERRED_YEARS = 10, 20
TARGET_NOTE = (
    "Hazard on the next day: on station-days that event reports cover, whether one was reported; on all others the rule"
    " over the day's climate indices stands in for it."
)
LIMIT_NOTE = (
    "One day ahead only. One to two weeks ahead need ensembles of weather models as input, months ahead seasonal ensembles."
)


@dataclass
class Trained:
    hazard: PipelineModel | None
    hazard_scaler: MinMax
    temperature: LagModel | None
    sequence_scaler: MinMax
    fusion: PipelineModel | None = None
    event: PipelineModel | None = None
    event_scaler: MinMax | None = None
    event_threshold: float = 0.5
    metrics: dict = field(default_factory=dict)
    manifest: dict = field(default_factory=dict)

    def models(self) -> dict:
        return {"hazard": self.hazard, "event": self.event, "temperature": self.temperature, "fusion": self.fusion}

    def scalers(self) -> dict:
        return {"hazard": self.hazard_scaler, "sequence": self.sequence_scaler, "event": self.event_scaler}

    @classmethod
    def restored(cls, parts: dict) -> "Trained":
        """From what ``load_models`` found; a part that was not saved stays None."""
        models, scalers = parts["models"], parts["scalers"]
        return cls(
            models["hazard"], scalers.get("hazard"), models["temperature"], scalers.get("sequence"), models["fusion"],
            models["event"], scalers.get("event"), parts["threshold"],
        )


def part(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split)


def hazard_scores(df: DataFrame, t: Trained) -> DataFrame:
    scored = L.with_probability(t.hazard_scaler.transform(df, L.SCALED), t.hazard, "hazard_prob")
    return scored.drop(*L.scaled_names(FEATURES))


def temperature_scores(panel: DataFrame, t: Trained) -> DataFrame:
    """Scaled next-day temperature per (station, split, day); no window crosses a split."""
    scaled = t.sequence_scaler.transform(panel.select(STATION, DAY, "split", *SEQUENCE))
    windows = L.window_vector(sequences(scaled, SEQUENCE_DAYS))
    last = F.element_at("sequence", -1)["TAVG"].alias("persisted")
    return t.temperature.transform(windows).select(STATION, DAY, "split", "target", "temp_pred", last)


def train_event_model(panel: DataFrame, t: Trained, trees: int, cuts: tuple[str, str]) -> dict:
    """Fit on covered rows if the split allows; tune the threshold on the validation year. Later rows alone are scored."""
    events = event_split(panel.drop("split"), *cuts)
    ready = event_readiness(events).first()
    if not ready["trained"]:
        return {"event_model_trained": False, "event_model_reason": ready["reason"], "event_model_rows": ready["rows"]}
    t.event_scaler = minmax_fit(part(events, "train"), FEATURES)
    scaled = t.event_scaler.transform(events, L.SCALED)
    t.event = L.event_forest(part(scaled, "train"), trees=trees)
    later = scaled.filter(F.col("split") != "train")
    scored = settle(
        L.with_probability(later, t.event, "score").select("split", F.col("EVENT_LABEL").alias("y"), "score"), "event"
    )
    best = tune_threshold(part(scored, "validation")).first()
    t.event_threshold = best["threshold"]
    test = part(scored, "test").withColumn("called", flag(F.col("score") >= t.event_threshold))
    cells, ranked = classification_metrics(test, "y", "called").first(), ranking_metrics(test).first()
    return {
        "event_model_trained": True, "event_model_threshold": best["threshold"], "event_model_val_f1": best["f1"],
        **{f"event_model_{s}_rows": ready[f"{s}_rows"] for s in ("train", "validation", "test")},
        **{f"event_model_test_{m}": cells[m] for m in ("accuracy", "precision", "recall", "f1", "positive_rate")},
        "event_model_test_auc": ranked["roc_auc"], "event_model_test_average_precision": ranked["average_precision"],
    }


def train(
    features: DataFrame, trees: int = 100, fusion_iterations: int = 50, event_cuts=(EVENT_VALIDATION_FROM, EVENT_TEST_FROM),
    written: bool = False,
) -> Trained:
    """Hazard forest, temperature regression, late fusion and event forest with their metrics.

    The split panel is written once; each model fit, score table and metric reads only its columns
    of it. ``written`` tells that ``features`` is a written table itself: then only the split of each day is written. What was written for the run is deleted at its end. The models that need no other one are fitted at the same
    time, as the levels of a forest leave executors idle.
    """
    with owned_tables(features.sparkSession), ThreadPoolExecutor(3) as pool:
        return fit_all(split_panel(features, written), trees, fusion_iterations, event_cuts, pool)


def beside(pool: ThreadPoolExecutor, df: DataFrame, job, *args, **options) -> Future:
    """Starts a job of its own; what it writes belongs to the ``owned_tables`` around the call."""
    return pool.submit(copy_context().run, inheritable_thread_target(df.sparkSession)(job), *args, **options)


def split_panel(features: DataFrame, written: bool) -> DataFrame:
    split = with_splits(features, settle(day_splits(features), "days")) if written else settle(chronological_split(features), "split")
    return require_splits(split.fillna(0, subset=SEQUENCE))


def fit_temperature(steps: DataFrame, held_out: DataFrame, t: Trained) -> DataFrame:
    """The regression, and its scores of later rows; both need no forest."""
    t.temperature = lagged_ridge(steps, length=SEQUENCE_DAYS)
    return settle(temperature_scores(held_out, t), "temperature")


def fit_all(
    panel: DataFrame, trees: int, fusion_iterations: int, event_cuts: tuple[str, str], pool: ThreadPoolExecutor
) -> Trained:
    train_rows, held_out = part(panel, "train"), panel.filter(F.col("split") != "train")
    ranges = minmax_fit(train_rows, FEATURES + [c for c in SEQUENCE if c not in FEATURES])
    hazard_scaler = MinMax({c: ranges.low[c] for c in FEATURES}, {c: ranges.high[c] for c in FEATURES})
    sequence_scaler = MinMax({c: ranges.low[c] for c in SEQUENCE}, {c: ranges.high[c] for c in SEQUENCE})
    t = Trained(None, hazard_scaler, None, sequence_scaler)
    hazard = beside(pool, panel, L.hazard_forest, hazard_scaler.transform(train_rows, L.SCALED), trees=trees)
    steps = sequence_scaler.transform(train_rows.select(STATION, DAY, "split", *SEQUENCE))
    temperature = beside(pool, panel, fit_temperature, steps, held_out, t)
    event = beside(pool, panel, train_event_model, panel, t, trees, event_cuts)
    t.hazard = hazard.result()
    tabular = settle(
        hazard_scores(held_out, t).select(
            STATION, DAY, F.col("split").alias("part"), "RISK", "EVENT_LABEL", "EVENT_LABEL_AVAILABLE", "hazard_prob"
        ), "tabular",
    )
    temperature = temperature.result()
    fused = align_fusion_inputs(temperature, tabular)
    validation = fused.filter("part = 'validation'")
    t.fusion = L.fusion_classifier(validation, ["temp_pred", "hazard_prob"], "RISK", fusion_iterations)

    test = tabular.filter("part = 'test'").select("*", F.col("RISK").alias("y"), F.col("hazard_prob").alias("score"))
    called = test.withColumn("called", flag(F.col("score") > 0.5))
    t.metrics["rf_accuracy"] = classification_metrics(called, "y", "called").first()["accuracy"]
    t.metrics["rf_auc"] = ranking_metrics(test).first()["roc_auc"]
    low, span = sequence_scaler.low["TAVG"], sequence_scaler.span("TAVG")
    fit = regression_metrics(part(temperature, "test"), "target", "temp_pred", low, span).first()
    t.metrics |= {
        "temperature_mse_scaled": fit["mse_scaled"], "temperature_r2": fit["r2"],
        "temperature_mae_c": fit["mae"], "temperature_rmse_c": fit["rmse"],
    }
    kept = regression_metrics(part(temperature, "test"), "target", "persisted", low, span).first()
    t.metrics |= {"persistence_mae_c": kept["mae"], "persistence_rmse_c": kept["rmse"], "persistence_r2": kept["r2"]}
    scored = L.with_probability(fused.filter("part = 'test'"), t.fusion, "score").withColumn("y", F.col("RISK"))
    scored = settle(scored.select("y", "score", flag(F.col("score") >= 0.5).alias("called")), "fused")
    t.metrics["fusion_accuracy"] = classification_metrics(scored, "y", "called").first()["accuracy"]
    t.metrics["fusion_auc"] = ranking_metrics(scored).first()["roc_auc"]
    events = event_subset_metrics(test).first()
    t.metrics |= {
        "event_labeled_test_rows": events["rows"], "rf_event_accuracy": events["accuracy"],
        "rf_event_auc": events["roc_auc"],
    }
    t.metrics |= event.result()
    t.manifest = training_manifest(panel)
    return t


def training_manifest(panel: DataFrame) -> dict:
    """Split sizes and periods (three rows), station count and the fixed facts of the model."""
    manifest = {
        "forecast_horizon_days": 1, "sequence_length_days": SEQUENCE_DAYS, "rf_features": FEATURES, "target": TARGET_NOTE,
        "operational_limit": LIMIT_NOTE, "minimum_recommended_history_years": MINIMUM_YEARS, "preferred_history_years": PREFERRED_YEARS,
    }
    labelled = 0
    for row in split_manifest(panel).collect():
        manifest |= {f"{row['split']}_{k}": row[k] for k in ("rows", "start", "end")}
        labelled += row["labelled_rows"]
    manifest["station_count"] = panel.agg(F.countDistinct(STATION)).first()[0]
    manifest["event_labeled_rows"] = labelled
    return manifest
