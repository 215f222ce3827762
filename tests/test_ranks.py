"""Ranks, quantiles and metrics against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import metrics as M
from skyledger.operators import splits as S
from skyledger.operators.ranks import percent_rank, quantiles, ranged_levels


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    data = {"a": [rng.gauss(0, 20) for _ in range(2001)], "b": [float(rng.randint(0, 5)) for _ in range(400)], "c": [7.5],
            "d": [1.0, 2.0, 3.0, 4.0]}
    return data


@pytest.fixture(scope="module")
def frame(spark, values):
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("b", float("nan"))]
    return spark.createDataFrame(rows, "k string, v double").cache()


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_quantiles_match_numpy_for_any_number_of_parts(frame, values, parts):
    wanted = {"q05": 0.05, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    got = {r["k"]: r for r in quantiles(frame, ["k"], {n: ("v", p) for n, p in wanted.items()}, parts).collect()}
    for k, vs in values.items():
        for n, p in wanted.items():
            assert got[k][n] == pytest.approx(np.quantile(vs, p), abs=1e-9)


def test_percent_rank(frame, values):
    got = percent_rank(frame.filter("k = 'b'"), ["k"], "v", "share")
    for row in got.dropna(subset=["v"]).filter(~F.isnan("v")).distinct().collect():
        below = sum(x < row["v"] for x in values["b"])
        assert row["share"] == pytest.approx(below / (len(values["b"]) - 1))


@pytest.mark.parametrize("low,high", [(0.0, 1e-7), (0.0, 1.0), (-1e9, 1e9)])
def test_packed_values_spread_over_the_parts(spark, low, high):
    rows = [(low + (high - low) * i / 20_000,) for i in range(20_000)] + [(1e12,), (-1e12,)]
    levels = ranged_levels(spark.createDataFrame(rows, "v double"), [], "v", 16, {"n": F.count(F.lit(1))})
    sizes = levels.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("_bucket").collect()
    assert len(sizes) == 16 and max(r["n"] for r in sizes) < 3 * 20_002 / 16
    assert all(x["b"] < y["a"] for x, y in zip(sizes, sizes[1:]))


def scored(rng, n, tied):
    return [(int(rng.random() < 0.3), (rng.randint(0, 9) / 9 if tied else rng.random())) for _ in range(n)]


def brute(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        hits = sum(y for y, x in rows if x == s)
        called = sum(x >= s for _, x in rows)
        seen += hits
        ap += hits / len(pos) * seen / called
    return auc, ap


@pytest.mark.parametrize("tied", [True, False])
def test_ranking_metrics(spark, tied):
    rows = scored(random.Random(11), 500, tied)
    got = M.ranking_metrics(spark.createDataFrame(rows, "y int, score double")).first()
    auc, ap = brute(rows)
    assert got["roc_auc"] == pytest.approx(auc)
    assert got["average_precision"] == pytest.approx(ap)


def test_one_class_and_no_rows(spark):
    ones = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, score double")
    got = M.ranking_metrics(ones).first()
    assert (got["roc_auc"], got["average_precision"]) == (0.5, 1.0)
    empty = M.ranking_metrics(ones.filter("y = 5")).first()
    assert (empty["roc_auc"], empty["average_precision"]) == (0.5, 0.0)
    best = M.tune_threshold(ones).first()
    assert (best["threshold"], best["f1"]) == (0.5, 0.0)


def test_threshold_is_the_first_best_of_91(spark):
    rows = scored(random.Random(2), 300, True)
    got = M.tune_threshold(spark.createDataFrame(rows, "y int, score double")).first()
    best = (0.0, None)
    for i in range(91):
        t = 0.05 + i / 100
        tp = sum(y for y, s in rows if s >= t - 1e-9)
        called = sum(s >= t - 1e-9 for _, s in rows)
        f1 = 2 * tp / (called + sum(y for y, _ in rows))
        if f1 > best[0] + 1e-12:
            best = (f1, t)
    assert got["f1"] == pytest.approx(best[0])
    assert got["threshold"] == pytest.approx(best[1])


def test_zero_division_gives_zero(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "y int, called int")
    got = M.classification_metrics(rows, "y", "called").first()
    assert (got["precision"], got["recall"], got["f1"]) == (0.0, 0.0, 0.0)
    assert got["accuracy"] == pytest.approx(1 / 3)


def test_minmax_shifts_constant_columns(spark):
    rows = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    scaler = S.minmax_fit(rows, ["a", "b"])
    got = [tuple(r) for r in scaler.transform(rows).orderBy("a").collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0)]


def test_split_for_one_station_follows_row_position(spark):
    rows = spark.sql("SELECT 'S' City_ID, date_add(DATE '2001-01-01', CAST(id * 3 AS int)) Date FROM range(101)")
    got = {r["split"]: r["n"] for r in S.chronological_split(rows).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 70, "validation": 15, "test": 16}


def test_full_archive_uses_calendar_boundaries(spark):
    rows = spark.sql("SELECT 'S' City_ID, date_add(DATE '1995-01-01', CAST(id AS int)) Date FROM range(10800)")
    bounds = S.chronological_split(rows).groupBy("split").agg(F.min("Date").cast("string").alias("first"))
    assert {r["split"]: r["first"] for r in bounds.collect()} == {
        "train": "1995-01-01", "validation": "2019-01-01", "test": "2022-01-01",
    }


def test_small_split_raises(spark):
    rows = spark.sql("SELECT 'S' City_ID, date_add(DATE '2001-01-01', CAST(id AS int)) Date FROM range(50)")
    with pytest.raises(S.SmallSplit):
        S.require_splits(S.chronological_split(rows))


def test_class_weights_are_balanced(spark):
    rows = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    assert {r["y"]: r["weight"] for r in S.class_weights(rows, "y").collect()} == {1: 2.0, 0: pytest.approx(2 / 3)}
