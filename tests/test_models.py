"""Forests as node tables, bootstraps with weights of their own, bags of forests."""

import math
import os
import random
import threading
from datetime import date, datetime, timedelta

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from skyledger.operators import learners as L
from skyledger.operators.bootstrap import bootstrap_weights, poisson_limits
from skyledger.operators.lagged import lagged_moments, lagged_ridge
from skyledger.operators.lineage import settle
from skyledger.operators.nodes import depth, node_importances, node_table, with_node_scores
from skyledger.operators.rolling import sequences
from skyledger.operators.splits import SmallSplit
from skyledger.operators.timing import event_rates
from skyledger.plans import training
from skyledger.plans.chips import fuse_chips
from skyledger.schema import FEATURES, SEQUENCE
from skyledger.sources.writers import load_models, save_models

X = ["a", "b", "c"]
NODES = "tree int, node int, feature int, threshold double, left int, right int, probability double, gain double, weight double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, rng.random(), rng.gauss(0, 1), float(rng.randint(0, 4))) for i in range(600)]
    return spark.createDataFrame(data, "id int, a double, b double, c double").withColumn(
        "label", ((F.col("a") > 0.5) != (F.col("b") + F.col("c") > 2)).cast("double"))


@pytest.fixture(scope="module")
def forest(rows):
    ready = VectorAssembler(inputCols=X, outputCol="features").transform(rows).withColumn("weight", 1.0 + F.col("id") % 3)
    return RandomForestClassifier(numTrees=7, maxDepth=5, seed=2, weightCol="weight").fit(ready)


def test_node_scores_equal_mllib(spark, rows, forest):
    nodes = node_table(spark, forest)
    assert depth(nodes) == max(t.depth for t in forest.trees) and nodes.count() == forest.totalNumNodes
    ready = VectorAssembler(inputCols=X, outputCol="features").transform(rows)
    both = forest.transform(ready).select("id", vector_to_array("probability")[1].alias("p")).join(
        with_node_scores(rows, nodes, X, ["id"], "mine"), "id").collect()
    assert len(both) == 600 and len({round(r["p"], 9) for r in both}) > 20
    assert all(math.isclose(r["p"], r["mine"], abs_tol=1e-12) for r in both)


def test_node_importances_equal_mllib(spark, forest):
    found = {r["feature"]: r["importance"] for r in node_importances(node_table(spark, forest), X).collect()}
    assert [found[c] for c in X] == pytest.approx(list(forest.featureImportances.toArray()), abs=1e-12)
    assert min(found.values()) > 0.05


def test_tables_of_one_node_and_of_none(spark, rows):
    lone = spark.createDataFrame([(0, 0, None, None, None, None, 0.25, None, 4.0), (1, 0, None, None, None, None, 0.75, None, 4.0)], NODES)
    got = with_node_scores(rows, lone, X, ["id"], "p").collect()
    assert len(got) == 600 and {r["p"] for r in got} == {0.5}
    assert {r["importance"] for r in node_importances(lone, X).collect()} == {0.0}
    with pytest.raises(ValueError, match="no nodes"):
        with_node_scores(rows, lone.limit(0), X, ["id"], "p")


def test_a_null_goes_to_the_right(spark):
    nodes = spark.createDataFrame([
        (0, 0, 0, 1.0, 1, 2, 0.5, 0.1, 4.0), (0, 1, None, None, None, None, 0.1, None, 2.0), (0, 2, None, None, None, None, 0.9, None, 2.0)], NODES)
    df = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 1.5), (4, None)], "id int, x double")
    assert {r["id"]: r["p"] for r in with_node_scores(df, nodes, ["x"], ["id"], "p").collect()} == {1: 0.1, 2: 0.1, 3: 0.9, 4: 0.9}


def test_the_depth_of_a_small_forest_needs_no_job_a_level(spark, rows, forest, monkeypatch):
    nodes = settle(node_table(spark, forest), "nodes")
    levels = max(t.depth for t in forest.trees)
    with monkeypatch.context() as m:
        m.setattr(type(nodes), "isEmpty", lambda self: pytest.fail("a job for a level"))
        assert depth(nodes) == levels > 2
        assert depth(nodes.filter("feature IS NULL AND node = 0")) == 0
        few = {r["id"]: r["p"] for r in with_node_scores(rows, nodes, X, ["id"], "p").collect()}
    monkeypatch.setattr("skyledger.operators.nodes.MOST_NODES", 1)
    assert depth(nodes) == levels
    assert {r["id"]: r["p"] for r in with_node_scores(rows, nodes, X, ["id"], "p").collect()} == pytest.approx(few, abs=1e-12)


def test_trees_of_any_numbers_keep_their_own_nodes(spark):
    """Tree 2 has more nodes than tree 0 and there is no tree 1: places over all trees do not meet."""
    nodes = spark.createDataFrame([
        (0, 0, 0, 1.0, 1, 2, 0.5, 0.1, 4.0), (0, 1, None, None, None, None, 0.1, None, 2.0), (0, 2, None, None, None, None, 0.2, None, 2.0),
        (2, 0, 0, 2.0, 1, 4, 0.5, 0.1, 4.0), (2, 1, 0, 1.0, 2, 3, 0.5, 0.1, 4.0), (2, 2, None, None, None, None, 0.3, None, 2.0),
        (2, 3, None, None, None, None, 0.5, None, 2.0), (2, 4, None, None, None, None, 0.9, None, 2.0)], NODES)
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 2.5)], "id int, x double")
    found = {r["id"]: r["p"] for r in with_node_scores(df, nodes, ["x"], ["id"], "p").collect()}
    assert depth(nodes) == 2 and found == pytest.approx({1: 0.2, 2: 0.35, 3: 0.55}, abs=1e-12)


def test_a_draw_takes_few_hashes(spark, capsys):
    df = spark.range(10).select(F.col("id").alias("key"), (F.col("id") % 2).cast("double").alias("y"))
    bootstrap_weights(df, "y", ["key"], 3, 5).explain()
    # The filter and the copies, in the counted rows and in the joined ones; not one for each limit.
    assert 0 < capsys.readouterr().out.count("md5(") <= 6


def test_rows_remember_their_nodes_and_fits_of_a_bag_overlap(rows, monkeypatch):
    scaled = rows.select("id", F.col("label").alias("EVENT_LABEL"), F.col("label").alias("RISK"), *[F.col(c).alias(L.SCALED + c) for c in X])
    assert L.forest_of(L.hazard_forest(scaled, X, trees=2)).getCacheNodeIds()
    both, fit = threading.Barrier(2), RandomForestClassifier.fit

    def met(self, data, params=None):
        both.wait(60)
        assert [r[0] for r in data.select("bootstrap").distinct().collect()] == [self.getSeed() - 143]
        return fit(self, data, params)

    monkeypatch.setattr(RandomForestClassifier, "fit", met)
    bag = L.event_forest(scaled, X, trees=5, bootstraps=2, keys=("id",))
    assert [L.forest_of(m).getNumTrees for m in bag.models] == [3, 2]
    assert all(L.forest_of(m).getCacheNodeIds() for m in bag.models)


def test_draws_are_poisson_and_each_bootstrap_is_balanced(spark):
    df = spark.range(20_000).select(F.col("id").alias("key"), (F.col("id") % 10 == 0).cast("double").alias("y"))
    drawn = bootstrap_weights(df, "y", ["key"], 3, 5)
    again = {(r["key"], r["bootstrap"]): r["copies"] for r in bootstrap_weights(df.repartition(7), "y", ["key"], 3, 5).collect()}
    rows = drawn.collect()
    assert {(r["key"], r["bootstrap"]): r["copies"] for r in rows} == again
    for b in range(3):
        mine = [r for r in rows if r["bootstrap"] == b]
        assert sum(r["copies"] for r in mine) == pytest.approx(20_000, rel=0.03)
        for k in (1, 2, 3):
            assert sum(r["copies"] == k for r in mine) == pytest.approx(20_000 * math.exp(-1) / math.factorial(k), rel=0.08)
        by_class = [sum(r["weight"] for r in mine if r["y"] == y) for y in (0.0, 1.0)]
        assert by_class[0] == pytest.approx(by_class[1])
    assert len({frozenset(r["key"] for r in rows if r["bootstrap"] == b) for b in range(3)}) == 3
    assert poisson_limits()[-1] < 1 and bootstrap_weights(df.withColumn("y", F.lit(None).cast("double")), "y", ["key"], 3, 5).count() == 0


def test_a_bag_averages_its_forests_and_survives_saving(spark, rows, tmp_path):
    scaled = rows.select("id", F.col("label").alias("EVENT_LABEL"), *[F.col(c).alias(L.SCALED + c) for c in X])
    bag = L.event_forest(scaled, X, trees=5, bootstraps=2, keys=("id",))
    assert [L.forest_of(m).getNumTrees for m in bag.models] == [3, 2]
    parts = [{r["id"]: r["p"] for r in L.with_probability(scaled, m, "p").collect()} for m in bag.models]
    got = {r["id"]: r["p"] for r in L.with_probability(scaled, bag, "p").collect()}
    assert all(got[i] == pytest.approx((3 * parts[0][i] + 2 * parts[1][i]) / 5) for i in got)
    right = sum((p >= 0.5) == bool(r["EVENT_LABEL"]) for r in scaled.collect() for p in [got[r["id"]]])
    assert right > 0.85 * 600
    save_models(spark, str(tmp_path / "m"), {"event": bag}, {}, 0.4)
    again = load_models(spark, str(tmp_path / "m"))
    assert {r["id"]: r["p"] for r in L.with_probability(scaled, again["models"]["event"], "p").collect()} == got
    assert again["threshold"] == 0.4 and again["models"]["hazard"] is None


def test_contributions_take_the_sum_of_a_row_once(spark, capsys):
    df = spark.createDataFrame([(1.0, 3.0, None), (0.0, -1.0, 0.0)], "a double, b double, c double")
    shares = df.select(L.contributions(X, [0.5, 0.25, 0.25]).alias("shares"))
    assert [r[0] for r in shares.collect()] == [[0.4, 0.6, 0.0], [0.1, 0.1, 0.1]]
    shares.explain()
    assert "/ aggregate(" not in capsys.readouterr().out


def test_forests_of_a_bag_share_one_vector(rows, monkeypatch):
    scaled = rows.select("id", F.col("label").alias("EVENT_LABEL"), *[F.col(c).alias(L.SCALED + c) for c in X])
    bag, made, transform = L.event_forest(scaled, X, trees=2, bootstraps=2, keys=("id",)), [], VectorAssembler.transform
    monkeypatch.setattr(VectorAssembler, "transform", lambda self, *args: made.append(1) or transform(self, *args))
    scored = L.with_probability(scaled, bag, "p")
    assert len(made) == 1 and scored.columns == [*scaled.columns, "p"]


def test_models_that_need_no_other_are_fitted_at_a_time(spark, monkeypatch):
    """Each waits for the other two; what one of them writes is deleted with the run."""
    together, written = threading.Barrier(3), []

    class Met(Exception):
        pass

    def met(*args, **options):
        written.append(settle(spark.range(1), "met").inputFiles()[0])
        together.wait(60)
        raise Met

    monkeypatch.setattr(L, "hazard_forest", met)
    monkeypatch.setattr(training, "lagged_ridge", met)
    monkeypatch.setattr(training, "train_event_model", met)
    columns = dict.fromkeys([*FEATURES, *SEQUENCE, "RISK", "EVENT_LABEL", "EVENT_LABEL_AVAILABLE"])
    days = spark.range(400).select(
        F.lit("A").alias("City_ID"), F.expr("date_add(date'2001-01-01', int(id))").alias("Date"), *[(F.col("id") % 7).cast("double").alias(c) for c in columns])
    with pytest.raises(Met):
        training.train(days, trees=2)
    assert len(written) == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in written)


def dated(spark):
    columns = dict.fromkeys([*FEATURES, *SEQUENCE, "RISK"])
    return spark.range(400).select(
        F.lit("A").alias("City_ID"), F.when(F.col("id") != 7, F.expr("date_add(date'2001-01-01', int(id))")).alias("Date"),
        *[F.when(F.col("id") % 9 != 4, (F.col("id") % 7).cast("double")).alias(c) for c in columns],
        (F.col("id") % 2).cast("double").alias("EVENT_LABEL"), F.lit(1).alias("EVENT_LABEL_AVAILABLE"))


def test_a_written_panel_is_not_written_again(spark, monkeypatch):
    """Only the split of each day is; the rows are those of a panel that was not written, the one without a day among them."""
    days, written = dated(spark), []
    monkeypatch.setattr(training, "settle", lambda df, name: written.append((name, df.columns)) or settle(df, name))
    once, again = (training.split_panel(days, w) for w in (True, False))
    assert written == [("days", ["Date", "split"]), ("split", again.columns)]
    assert once.columns == again.columns and once.count() == 400
    assert once.exceptAll(again).count() == again.exceptAll(once).count() == 0


def test_the_event_model_scores_later_rows_only(spark, monkeypatch):
    seen = []

    def noted(df, model, out):
        seen.extend(sorted(r[0] for r in df.select("split").distinct().collect()))
        return df.withColumn(out, F.lit(0.6))

    monkeypatch.setattr(L, "event_forest", lambda *args, **options: None)
    monkeypatch.setattr(L, "with_probability", noted)
    panel = dated(spark).filter("Date is not null").fillna(0)
    found = training.train_event_model(panel, training.Trained(None, None, None, None), 2, ("2001-06-01", "2001-09-01"))
    assert seen == ["test", "validation"]
    assert [found[f"event_model_{s}_rows"] for s in ("train", "validation", "test")] == [150, 92, 157]


@pytest.mark.parametrize("length", [30, 3])
def test_lagged_ridge_equals_the_fit_on_windows(spark, length):
    """Series that cross chunks, are cut by splits, or are too short for a window; a column that follows from others."""
    rng = random.Random(8)
    data = []
    for station, first, days in (("A", date(1999, 10, 1), 300), ("B", date(2003, 11, 20), 120), ("C", date(2001, 1, 1), 31), ("D", date(2001, 1, 1), 20)):
        level = 10.0
        for k in range(days):
            level = 0.8 * level + rng.gauss(2, 3)
            low = level - rng.random() * 5
            data.append((station, "train" if k < days * 0.7 else "test", first + timedelta(days=k * 3), level, low, (level + low) / 2,
                         None if rng.random() < 0.1 else rng.random(), 4.0))
    df = spark.createDataFrame(data, "City_ID string, split string, Date date, TMAX double, TMIN double, TAVG double, PRCP double, SST double")
    windows = L.window_vector(sequences(df, length))
    fitted = L.next_day_temperature(windows)
    model = lagged_ridge(df, length=length)
    assert model.weights == pytest.approx(list(fitted.coefficients.toArray()), abs=1e-6)
    assert model.intercept == pytest.approx(fitted.intercept, abs=1e-6)
    both = fitted.transform(windows).withColumnRenamed("temp_pred", "p")
    assert all(r["p"] == pytest.approx(r["temp_pred"], abs=1e-6) for r in model.transform(both).collect())


def test_lagged_moments_make_no_windows(spark, capsys):
    df = spark.createDataFrame([("A", "all", date(2000, 1, 1), 1.0, 0.0)], "City_ID string, split string, Date date, TAVG double, SST double")
    lagged_moments(df, ["TAVG", "SST"], 30).explain()
    assert "collect_list" not in capsys.readouterr().out
    with pytest.raises(ValueError, match="predecessors"):
        lagged_ridge(df, ["TAVG", "SST"])


def test_lagged_rows_are_few_enough_fields_for_whole_stage_code(spark, capsys):
    df = spark.createDataFrame([("A", "all", date(2000, 1, 1), *[1.0] * 5)], "City_ID string, split string, Date date, " + ", ".join(f"{c} double" for c in SEQUENCE))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lagged_moments(df, SEQUENCE, 30).explain()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "*" in next(line for line in capsys.readouterr().out.splitlines() if "Generate posexplode" in line)


def test_forests_write_no_checkpoint_of_the_nodes_of_rows(rows):
    scaled = rows.select("id", F.col("label").alias("EVENT_LABEL"), F.col("label").alias("RISK"), *[F.col(c).alias(L.SCALED + c) for c in X])
    bag = L.event_forest(scaled, X, trees=2, bootstraps=2, keys=("id",))
    assert [L.forest_of(m).getCheckpointInterval() for m in (*bag.models, L.hazard_forest(scaled, X, trees=2))] == [-1, -1, -1]


def chips_and_rates(spark, days: int, seed: int = 4):
    """Two sources of evidence, each with its own noise, over chips that lie evenly over ``days``."""
    rng = random.Random(seed)
    chips, rates = [], {}
    for i in range(3000):
        station, day = f"S{i % 5}", date(2022, 1, 1) + timedelta(days=rng.randrange(days))
        wet = rates.setdefault((station, day), rng.random())
        chip = rng.random()
        hit = int(rng.random() < 1 / (1 + math.exp(6 - 6 * chip - 4 * wet)))
        chips.append((i, station, datetime(day.year, day.month, day.day, rng.randrange(24)), chip, -1 if rng.random() < 0.1 else hit))
    return (
        spark.createDataFrame(chips, "chip_id int, City_ID string, ts timestamp_ntz, chip_prob double, label int"),
        spark.createDataFrame([(s, d, p) for (s, d), p in rates.items()], "City_ID string, Date date, event_prob double"),
    )


def test_chip_fusion_is_tuned_and_measured_on_periods_of_their_own(spark):
    chips, rates = chips_and_rates(spark, 1095)
    fused = fuse_chips(chips, rates)
    rows = fused.scored.collect()
    assert fused.metrics["split_strategy"] == "dates" and len(rows) == chips.filter("label >= 0").count()
    year = {"train": 2022, "validation": 2023, "test": 2024}
    assert all(r["Date"].year == year[r["split"]] for r in rows)

    def f1(part, threshold):
        mine = [r for r in rows if r["split"] == part]
        hits = sum(r["label"] for r in mine if r["score"] >= threshold)
        return 2 * hits / (sum(r["score"] >= threshold for r in mine) + sum(r["label"] for r in mine))

    best = max(range(5, 96), key=lambda pct: (f1("validation", pct / 100), -pct)) / 100
    assert fused.threshold == best and fused.metrics["validation_f1"] == pytest.approx(f1("validation", best))
    assert fused.metrics["test_f1"] == pytest.approx(f1("test", best))
    test = [r for r in rows if r["split"] == "test"]
    assert fused.metrics["test_accuracy"] == pytest.approx(sum(r["label"] == r["called"] for r in test) / len(test))
    positive, negative = ([r["score"] for r in test if r["label"] == y] for y in (1, 0))
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    assert fused.metrics["test_auc"] == pytest.approx(wins / (len(positive) * len(negative)))
    # Both sides together rank better than either alone.
    alone = [sum((p > n) + 0.5 * (p == n) for p in a for n in b) / (len(a) * len(b)) for a, b in (
        ([r[c] for r in test if r["label"] == 1], [r[c] for r in test if r["label"] == 0]) for c in ("chip_prob", "event_prob"))]
    assert fused.metrics["test_auc"] > max(alone) + 0.01


def test_chip_fusion_meets_the_optimum(spark):
    """At the fitted coefficients the slope of the penalised loss is nil."""
    chips, rates = chips_and_rates(spark, 1095, seed=9)
    fused = fuse_chips(chips, rates)
    train = [r for r in fused.scored.collect() if r["split"] == "train"]
    weights = fused.model.stages[-1].coefficients
    assert sum(r["score"] - r["label"] for r in train) / len(train) == pytest.approx(0, abs=1e-7)
    for j, c in enumerate(("chip_prob", "event_prob")):
        slope = sum((r["score"] - r["label"]) * r[c] for r in train) / len(train)
        mean = sum(r[c] for r in train) / len(train)
        spread = sum((r[c] - mean) ** 2 for r in train) / (len(train) - 1)
        assert slope + L.FUSION_RIDGE * weights[j] * spread == pytest.approx(0, abs=1e-6)


def test_chip_fusion_falls_back_to_shares_or_says_why_not(spark):
    chips, rates = chips_and_rates(spark, 300)
    fused = fuse_chips(chips, rates)
    assert fused.metrics["split_strategy"] == "shares"
    ends = {r["split"]: (r["a"], r["b"]) for r in fused.scored.groupBy("split").agg(F.min("Date").alias("a"), F.max("Date").alias("b")).collect()}
    assert ends["train"][1] < ends["validation"][0] and ends["validation"][1] < ends["test"][0]
    for few in (chips.limit(0), chips.limit(40), chips.withColumn("label", F.least("label", F.lit(0))), chips.withColumn("chip_prob", F.lit(None).cast("double"))):
        with pytest.raises(SmallSplit, match="too few labelled chips"):
            fuse_chips(few, rates)


def test_event_rates_see_earlier_days_only(spark):
    day = lambda k: date(2022, 3, 1) + timedelta(days=k)
    days = spark.createDataFrame([(s, day(k)) for s in "AB" for k in (0, 3, 4, 9, 9)] + [(None, day(1)), ("A", None)], "City_ID string, Date date")
    events = spark.createDataFrame([("A", day(3)), ("A", day(3)), ("A", day(7)), ("C", day(1))], "City_ID string, Date date")
    got = {(r["City_ID"], r["Date"]): r["event_prob"] for r in event_rates(days, events).collect()}
    assert got == {
        ("A", day(0)): 1 / 2, ("A", day(3)): 1 / 5, ("A", day(4)): 2 / 6, ("A", day(9)): 3 / 11,
        ("B", day(0)): 1 / 2, ("B", day(3)): 1 / 5, ("B", day(4)): 1 / 6, ("B", day(9)): 1 / 11}
    assert event_rates(days.limit(0), events).count() == 0
