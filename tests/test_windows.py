"""Chunked windows against plain per-station windows, with one station holding most rows."""

import random
import re
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import Window, functions as F

from skyledger.operators import rolling as R
from skyledger.operators.chunks import CHUNK, COPY, carry, join_by_station, with_chunk, with_neighbours
from skyledger.operators.lineage import CLEANUP, settle
from skyledger.operators.target import drought_index
from skyledger.plans.assemble import assemble
from skyledger.plans.features import feature_panel
from skyledger.schema import DAY, FEATURES, STATION

SCHEMA = "City_ID string, Date date, TMAX double, TMIN double, PRCP double"


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(5)
    rows = []

    def add(station, start, days, keep):
        for i in range(days):
            if rng.random() < keep:
                value = lambda: None if rng.random() < 0.15 else float(rng.randint(-20, 40))
                rows.append((station, start + timedelta(days=i), value(), value(), value()))

    add("HOT", date(1960, 1, 1), 14000, 0.9)
    add("SPARSE", date(1970, 1, 1), 12000, 0.004)
    add("SHORT", date(1999, 12, 20), 25, 1.0)
    rows.append(("SINGLE", date(2003, 12, 31), 1.0, 2.0, 3.0))
    rows += [("GAPPED", date(y, 12, 31), float(y % 7), None, 1.0) for y in range(1961, 2020, 9)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def plain():
    return Window.partitionBy(STATION).orderBy(DAY)


def differing(left, right, columns):
    right = right.select(STATION, DAY, *[F.col(c).alias(f"r_{c}") for c in columns])
    joined = left.join(right, [STATION, DAY], "full")
    wrong = F.lit(False)
    for c in columns:
        a, b = F.col(c), F.col(f"r_{c}")
        wrong = wrong | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > 1e-9, F.lit(False))
    return joined.filter(wrong).count()


def test_frames_match_plain_windows(panel):
    frames = [R.Frame("s3", "sum", "PRCP", 3), R.Frame("m30", "mean", "TMAX", 30), R.Frame("x7", "max", "TMIN", 7),
              R.Frame("a14", "anomaly", "PRCP", 14), R.Frame("d3", "drop", "TMAX", 3)]
    got = R.rolling(panel, frames, {"next": "TMAX"})
    w = lambda n: plain().rowsBetween(-(n - 1), 0)
    drop = F.max("TMAX").over(w(3)) - F.col("TMAX")
    want = panel.withColumns({
        "s3": F.sum("PRCP").over(w(3)), "m30": F.avg("TMAX").over(w(30)), "x7": F.max("TMIN").over(w(7)),
        "a14": F.col("PRCP") - F.avg("PRCP").over(w(14)), "d3": drop, "next": F.lead("TMAX").over(plain()),
    })
    assert got.count() == panel.count()
    assert differing(got, want, ["s3", "m30", "x7", "a14", "d3", "next"]) == 0


def test_last_row_of_a_station_has_no_next(panel):
    got = R.next_day(panel.filter("City_ID = 'SINGLE'"), "TMAX", "next").first()
    assert got["next"] is None


def test_chunks_bound_every_group(panel):
    ready = with_neighbours(with_chunk(panel), 29, 1)
    largest = ready.groupBy(STATION, CHUNK).count().agg(F.max("count")).first()[0]
    assert largest <= 4 * 366 + 30
    assert ready.filter(~F.col(COPY)).count() == panel.count()


def test_carry_reaches_over_any_distance(panel):
    got = carry(with_chunk(panel), ["TMAX", "TMIN"])
    back, ahead = plain().rowsBetween(Window.unboundedPreceding, 0), plain().rowsBetween(0, Window.unboundedFollowing)
    want = panel.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in ("TMAX", "TMIN")})
    assert differing(got, want, ["TMAX", "TMIN"]) == 0


def test_carry_sorts_the_rows_once(panel, capsys):
    carry(with_chunk(panel), ["TMAX"]).explain()
    sorts = [line for line in capsys.readouterr().out.splitlines() if "Sort [" in line and "Date#" in line]
    assert len(sorts) == 1 and "DESC" not in sorts[0]


def test_drought_index(panel):
    mean = F.avg(F.coalesce("PRCP", F.lit(0.0))).over(plain().rowsBetween(-29, 0))
    want = panel.withColumn("m", mean)
    want = want.withColumn("gap", F.avg("m").over(Window.partitionBy(STATION)) - F.col("m"))
    want = want.withColumn("DROUGHT_IDX", F.when(F.col("gap") < 0, 0.0).otherwise(F.col("gap")))
    assert differing(drought_index(panel), want, ["DROUGHT_IDX"]) == 0


def test_sequences_stay_inside_their_split(panel):
    full = panel.withColumns({
        "TAVG": F.col("TMAX"), "SST": F.col("TMIN"),
        "split": F.when(F.col(DAY) < "1985-06-01", "train").otherwise("test"),
    })
    got = R.sequences(full)
    order = Window.partitionBy(STATION, "split").orderBy(DAY)
    expected = full.withColumn("n", F.row_number().over(order)).filter("n > 30").count()
    assert got.count() == expected
    assert got.filter(F.size("sequence") != 30).count() == 0
    assert {r[0] for r in got.select(STATION).distinct().collect()} <= {"HOT", "SPARSE"}
    assert all("skyledger-filled" in f for f in got.inputFiles())


def test_short_history_is_padded_with_its_first_row(spark, panel):
    history = panel.filter("City_ID = 'SINGLE'").withColumn("SST", F.lit(11.0))
    today = spark.createDataFrame([("SINGLE", 20.0, 10.0, 0.5), ("NEW", 1.0, 3.0, 0.0)], "City_ID string, TMAX double, TMIN double, PRCP double")
    rows = {r[0]: r[1] for r in R.scoring_sequences(history, today).collect()}
    assert [len(s) for s in rows.values()] == [30, 30]
    assert [s["TMAX"] for s in rows["SINGLE"]] == [1.0] * 29 + [20.0]
    assert rows["SINGLE"][29]["SST"] == 11.0
    assert {s["SST"] for s in rows["NEW"]} == {18.0}


def test_join_by_station_keeps_rows(spark, panel):
    table = spark.createDataFrame([("HOT", 1), ("SINGLE", 2)], "City_ID string, k int")
    got = join_by_station(panel, table, "left")
    assert got.count() == panel.count()
    assert got.filter("k = 1").count() == panel.filter("City_ID = 'HOT'").count()


def test_the_last_stage_of_the_panel_is_short_enough_to_be_compiled(spark, panel, capsys):
    """The JVM does not compile methods over 8,000 bytes."""
    labelled = assemble(panel).withColumns({
        "EVENT_LABEL": F.lit(1.0), "EVENT_LABEL_AVAILABLE": F.lit(0), "EVENT_TYPE": F.lit("a"), "EVENT_DISTANCE_KM": F.col("TMAX")})
    found = feature_panel(labelled.filter("City_ID <> 'HOT'"))
    assert {dict(found.dtypes)[c] for c in FEATURES} == {"double"}
    missing = found.filter(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in FEATURES))
    assert missing.isEmpty() and not found.filter("WET_BULB = 0").isEmpty()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found.select("*").explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_a_written_table_leaves_no_shuffle_files(spark, panel):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    rows = panel.repartition(7, "TMAX").groupBy(STATION).agg(F.sum("PRCP").alias("rain"))
    found = settle(rows, "few")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and found.count() == 5
    assert spark.conf.get(CLEANUP, None) == setting
