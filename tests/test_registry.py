"""Every registered query against its SQL at the smallest scale, and the models' bounds."""

import pathlib

import pytest
from pyspark.sql import functions as F

from skyledger.registry import QUERIES
from skyledger.registry.models import EVENT_CUTS, features
from skyledger.registry.proxies import Tables
from skyledger.plans.evidence import evidence_tables, write_evidence
from skyledger.plans.scoring import score_today
from skyledger.operators.lineage import owned_tables, settle, shared_folder
from skyledger.plans.training import Trained, hazard_scores, train
from skyledger.schema import DAY, FEATURES, STATION
from skyledger.sources.writers import load_models, read_json_row, save_models, write_run_report
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], FOLDER) is None


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def trained(tables):
    return train(features(tables), trees=5, fusion_iterations=10, event_cuts=EVENT_CUTS)


def test_manifest_boundaries_do_not_overlap(trained):
    m = trained.manifest
    assert m["train_end"] < m["validation_start"] and m["validation_end"] < m["test_start"]
    assert m["forecast_horizon_days"] == 1 and m["event_labeled_rows"] > 0
    assert m["rf_features"] == FEATURES and len(FEATURES) == 36


def test_metrics_are_plausible(trained):
    m = trained.metrics
    assert m["event_model_trained"] is True
    for name in ("rf_auc", "fusion_auc", "rf_event_auc", "event_model_test_f1", "rf_accuracy", "event_model_test_auc"):
        assert 0.0 <= m[name] <= 1.0
    assert 0.0 < m["event_model_threshold"] < 1.0
    assert 0.0 < m["temperature_mae_c"] < 40.0


def test_event_model_reports_why_it_is_not_trained(spark, tables):
    from skyledger.plans.training import train_event_model

    untrained = Trained(None, None, None, None)
    got = train_event_model(features(tables), untrained, 5, ("2023-01-01", "2024-01-01"))
    assert got["event_model_trained"] is False and got["event_model_reason"]
    assert untrained.event is None


def test_models_and_reports_reload(spark, tables, trained, tmp_path):
    folder = str(tmp_path)
    save_models(spark, folder, trained.models(), trained.scalers(), trained.event_threshold)
    write_run_report(spark, trained.metrics, trained.manifest, folder)
    again = Trained.restored(load_models(spark, folder))
    assert again.event_threshold == trained.event_threshold
    assert read_json_row(spark, f"{folder}/training_manifest")["train_rows"] == trained.manifest["train_rows"]
    history = features(tables)
    current = history.groupBy(STATION).agg(
        F.max("TMAX").alias("TMAX"), F.min("TMIN").alias("TMIN"), F.lit(8.0).alias("D"), F.lit(10.0).alias("W"),
        F.lit(1.0).alias("PRCP"),
    )
    scored = score_today(history, current, again).collect()
    assert len(scored) == history.select(STATION).distinct().count()
    for row in scored:
        assert 0 <= row["probability_pct"] <= 100 and 0 <= row["event_prob"] <= 1
        assert sum(row["contributions"]) == pytest.approx(1.0) or row["contributions"] == [0.1] * 36


def test_forest_probabilities_rank_like_mllib(spark, tables, trained):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from skyledger.operators.metrics import ranking_metrics
    from skyledger.plans.training import hazard_scores

    scored = hazard_scores(features(tables), trained).select(F.col("RISK").alias("label"), "hazard_prob").cache()
    mine = ranking_metrics(scored.select(F.col("label").cast("int").alias("y"), F.col("hazard_prob").alias("score"))).first()
    theirs = BinaryClassificationEvaluator(rawPredictionCol="hazard_prob", numBins=0).evaluate(scored)
    assert mine["roc_auc"] == pytest.approx(theirs, abs=1e-9)


def test_evidence_tables_are_written(spark, tables, tmp_path):
    written = evidence_tables(tables.obs(), tables.atmosphere(), tables.indices(), tables.sst())
    write_evidence(written, str(tmp_path))
    for name in written:
        assert spark.read.json(str(tmp_path / name)).count() > 0
    assert DAY not in written["annual"].columns


def test_manifest_holds_all_facts(trained):
    m = trained.manifest
    assert m["minimum_recommended_history_years"] == 10 and m["preferred_history_years"] == 20
    assert "next day" in m["target"] and "ensembles" in m["operational_limit"]


def written(spark):
    return {p.name for p in pathlib.Path(shared_folder(spark)).glob("skyledger-*")}


def test_a_training_run_leaves_no_path_behind(spark, tables):
    panel = features(tables)
    before = written(spark)
    model = train(panel, trees=2, fusion_iterations=3, event_cuts=EVENT_CUTS)
    assert written(spark) == before
    assert hazard_scores(panel, model).filter("hazard_prob IS NULL").count() == 0


def test_an_owner_deletes_what_its_body_wrote_even_after_an_error(spark):
    before = written(spark)
    outside = settle(spark.range(3), "outside")
    kept = written(spark) - before
    with pytest.raises(ZeroDivisionError):
        with owned_tables(spark):
            first = settle(spark.range(5), "first")
            with owned_tables(spark):
                assert settle(spark.range(7), "second").count() == 7 and len(written(spark) - before - kept) == 2
            assert first.count() == 5 and len(written(spark) - before - kept) == 1
            raise ZeroDivisionError
    assert written(spark) == before | kept and outside.count() == 3
