"""Edges that the registered queries do not reach."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skyledger.operators.enrichment import catalog_or_default, station_catalog
from skyledger.operators.lineage import shared_folder
from skyledger.operators.metrics import regression_metrics
from skyledger.operators.splits import chronological_split
from skyledger.schema import CATALOG_FILL, DAY
from skyledger.sources import readers

CATALOG = "station_id string, name string, region string, climate string, elevation double, lat double, lon double, ocean_basin string"


def test_an_empty_catalog_gets_the_default_row(spark):
    none = spark.createDataFrame([], CATALOG)
    rows = catalog_or_default(station_catalog(none, none)).collect()
    assert [(r.station_id, r.region, r.lat) for r in rows] == [("SEATTLE", CATALOG_FILL["region"], CATALOG_FILL["lat"])]
    some = spark.createDataFrame([("A", "a", None, None, 1.0, 2.0, 3.0, None)], CATALOG)
    assert [r.station_id for r in catalog_or_default(station_catalog(some, none)).collect()] == ["A"]


@pytest.mark.parametrize("predicted, r2", [([2.0, 2.0], 1.0), ([2.0, 2.5], 0.0)])
def test_r2_of_a_constant_truth(spark, predicted, r2):
    rows = spark.createDataFrame([(2.0, p) for p in predicted], "y double, p double")
    assert regression_metrics(rows, "y", "p").first()["r2"] == r2


def test_rows_without_a_day_stay_in_no_split(spark):
    rows = spark.range(11).select(F.when(F.col("id") < 10, F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int"))).alias(DAY))
    got = chronological_split(rows).collect()
    assert len(got) == 11 and [r["split"] for r in got if r[DAY] is None] == [None]
    assert all(r["split"] for r in got if r[DAY])


def test_a_cluster_needs_a_shared_folder():
    def session(master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077"))
    assert shared_folder(session("local[8]"))


def test_a_folder_of_chip_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station_id,timestamp,label\nusw1,2020-01-01 10:00:00,1\n")
    got = readers.read_chip_manifest(spark, str(tmp_path), csv=True).collect()
    assert [(r["City_ID"], r["label"]) for r in got] == [("USW1", 1)]
