"""Joins: row preservation, coverage rules, and distance and time joins against brute force."""

import glob
import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyledger.operators import enrichment as E
from skyledger.operators.cleaning import MissingStation, require_stations
from skyledger.operators.lineage import shared_folder
from skyledger.operators.radius import (
    chosen_donors, day_words, donors_by_rings, label_by_radius, neighbour_lists, place_dictionary, repair_gaps, ring_ends,
)
from skyledger.operators.timing import label_chips

D = date(2020, 1, 1)
PANEL = "City_ID string, Date date, TMAX double"


def days(station, n, start=D):
    return [(station, start + timedelta(days=i), float(i)) for i in range(n)]


def km(a, b):
    la, lo, lb, lp = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def test_duplicate_auxiliary_rows_do_not_fan_out(spark):
    panel = spark.createDataFrame(days("A", 3), PANEL)
    atm = spark.createDataFrame([("A", D, 50.0), ("A", D, 60.0)], "City_ID string, Date date, DEWPOINT_F double")
    got = E.join_atmosphere(panel, atm).orderBy("Date").collect()
    assert [r["DEWPOINT_F"] for r in got] == [60.0, None, None]


def test_soil_flag_three_cases(spark):
    panel = spark.createDataFrame(days("A", 3) + days("B", 1), PANEL)
    soil = spark.createDataFrame(
        [("A", D, 0.2, None), ("A", D + timedelta(days=1), None, None)],
        "City_ID string, Date date, SOIL_MOISTURE_VOL double, SATURATION_PCT double",
    )
    got = E.join_soil(panel, soil).orderBy("City_ID", "Date").collect()
    assert [r["SOIL_MOISTURE_OBSERVED"] for r in got] == [1.0, 0.0, None, 0.0]


def test_labels_merge_and_cover(spark):
    panel = spark.createDataFrame(days("A", 4) + days("B", 2), PANEL)
    raw = spark.createDataFrame(
        [("2020-01-01", "a", "0", "Wind", "9"), ("2020-01-01", "a", "1", "Flood", "3"), ("2020-01-03", "a", "x", None, "?"),
         ("never", "a", "1", "Hail", "1")],
        "date string, NOAA_STATION string, EVENT_LABEL string, EVENT_TYPE string, EVENT_DISTANCE_KM string",
    )
    labels = E.clean_labels(raw)
    got = E.label_coverage(E.join_event_labels(panel, labels), labels).orderBy("City_ID", "Date").collect()
    assert [(r["EVENT_LABEL"], r["EVENT_LABEL_AVAILABLE"]) for r in got] == [
        (1.0, 1), (0.0, 1), (0.0, 1), (None, 0), (None, 0), (None, 0),
    ]
    assert (got[0]["EVENT_TYPE"], got[0]["EVENT_DISTANCE_KM"]) == ("Flood; Wind", 3.0)


def test_labels_without_required_column_are_unavailable(spark):
    assert E.clean_labels(spark.createDataFrame([("2020-01-01", "A")], "date string, NOAA_STATION string")) is None
    got = E.join_event_labels(spark.createDataFrame(days("A", 2), PANEL), None)
    assert {tuple(r) for r in got.select("EVENT_LABEL", "EVENT_TYPE", "EVENT_LABEL_AVAILABLE").collect()} == {(None, "", 0)}


def test_absent_station_raises(spark):
    panel = spark.createDataFrame(days("A", 2), PANEL)
    with pytest.raises(MissingStation, match="GHOST"):
        require_stations(panel, spark.createDataFrame([("a",), ("ghost",)], "City_ID string"))


def test_sst_falls_back_to_the_constant(spark):
    panel = spark.createDataFrame(days("A", 2), PANEL)
    assert {r["SST"] for r in E.join_sst(panel).collect()} == {18.0}


def test_sst_of_an_unplaced_station_is_the_basin_mean(spark):
    panel = spark.createDataFrame(days("A", 3), PANEL)
    sst = spark.createDataFrame([(D + timedelta(days=1), 50.0, 68.0)], "Date date, sst_pacific_f double, sst_gulf_f double")
    assert {r["SST"] for r in E.join_sst_daily(panel, sst).collect()} == {15.0}


def test_radius_join_matches_brute_force(spark):
    rng = random.Random(9)
    places = [(f"S{i}", rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)) for i in range(150)]
    places += [(f"N{i}", 89.5 + i / 100, rng.uniform(-180, 180)) for i in range(10)]
    places += [("EAST", 10.0, 179.9), ("WEST", 10.0, -179.9)]
    events = [(D, rng.uniform(-89.9, 89.9), rng.uniform(-180, 180), f"t{i % 3}") for i in range(300)]
    events += [(D, 89.9, 0.0, "pole"), (D, 10.2, 179.99, "line")] + [(D, 10.1, -179.95, "hot")] * 200
    got = label_by_radius(
        spark.createDataFrame(events, "Date date, lat double, lon double, event_type string"),
        spark.createDataFrame(places, "station_id string, lat double, lon double"), km=700.0,
    ).collect()
    want = {}
    for s, lat, lon in places:
        near = [(km((lat, lon), e[1:3]), e[3]) for e in set(events)]
        near = [x for x in near if x[0] <= 700.0]
        if near:
            want[s] = ("; ".join(sorted({t for _, t in near})), min(near)[0])
    assert {r["City_ID"] for r in got} == set(want)
    for r in got:
        assert r["EVENT_TYPE"] == want[r["City_ID"]][0]
        assert r["EVENT_DISTANCE_KM"] == pytest.approx(want[r["City_ID"]][1], abs=1e-6)


def test_gap_repair_takes_the_exact_nearest_donor(spark):
    rng = random.Random(4)
    places = [(f"S{i:03d}", 40 + rng.uniform(-0.5, 0.5), -100 + rng.uniform(-0.5, 0.5)) for i in range(60)]
    places += [(f"F{i:03d}", 40 + rng.uniform(-8, 8), -100 + rng.uniform(-8, 8)) for i in range(60)]
    rows = [(s, D + timedelta(days=k), None if rng.random() < 0.4 else rng.uniform(900, 1000)) for s, _, _ in places for k in range(3)]
    got = repair_gaps(
        spark.createDataFrame(rows, "City_ID string, Date date, PRESSURE_HPA double"),
        spark.createDataFrame(places, "station_id string, lat double, lon double"), "PRESSURE_HPA", max_km=150.0,
    ).collect()
    at = {s: (a, o) for s, a, o in places}
    known = {(s, d): v for s, d, v in rows}
    assert len(got) == len(rows)
    for r in got:
        s, d = r["City_ID"], r["Date"]
        if known[s, d] is not None:
            assert (r["PRESSURE_HPA"], r["ATMOSPHERE_IMPUTED"], r["ATMOSPHERE_DONOR_KM"]) == (known[s, d], 0.0, 0.0)
            continue
        near = [(km(at[s], at[o]), o) for o in at if known[o, d] is not None and km(at[s], at[o]) <= 150.0]
        if not near:
            assert (r["PRESSURE_HPA"], r["ATMOSPHERE_IMPUTED"]) == (None, 0.0)
        else:
            assert r["ATMOSPHERE_DONOR_KM"] == pytest.approx(min(near)[0], abs=1e-6)
            assert r["PRESSURE_HPA"] == known[min(near)[1], d]


@pytest.mark.parametrize("bands", [(8, 64), (1, 2, 3), ()])
def test_gap_repair_of_a_dense_cell(spark, bands):
    """500 stations in one cell; most know few days, so that gaps walk far down the lists."""
    rng = random.Random(12)
    places = [(f"S{i:03d}", 40 + rng.randint(0, 40) / 100, -100 + rng.randint(0, 40) / 100) for i in range(500)]
    rows = [(s, D + timedelta(days=k), 1000.0 + i if rng.random() < 0.01 else None)
            for i, (s, _, _) in enumerate(places) for k in (-70, -1, 0, 1, 63, 64, 200)]
    df = spark.createDataFrame(rows, "City_ID string, Date date, PRESSURE_HPA double")
    stations = spark.createDataFrame(places, "station_id string, lat double, lon double")
    words, lists = day_words(df, "PRESSURE_HPA"), neighbour_lists(stations, 150.0)
    chosen = chosen_donors(words, lists, bands).collect()
    assert len(chosen) == len({(r["City_ID"], r["Date"]) for r in chosen})
    at = {s: (a, o) for s, a, o in places}
    known = {}
    for s, d, v in rows:
        if v is not None:
            known.setdefault(d, []).append(s)
    want = {(s, d): min((round(km(at[s], at[o]), 6), o) for o in known[d])[1] for s, d, v in rows if v is None and d in known}
    assert {(r["City_ID"], r["Date"]): r["donor"] for r in chosen} == want
    got = repair_gaps(df, stations, "PRESSURE_HPA", bands=bands)
    assert got.count() == len(rows) and got.filter("PRESSURE_HPA IS NOT NULL").count() == len(want) + sum(map(len, known.values()))


def test_gap_repair_of_odd_rows(spark):
    rows = [("A", D, None), ("A", D, None), ("A", None, None), (None, D, None), ("B", D, 5.0), ("B", D, 7.0), ("C", D, None), ("X", D, None)]
    places = [("A", 40.0, -100.0), ("B", 40.1, -100.0), ("C", None, -100.0), ("B", 40.1, -100.0)]
    df = spark.createDataFrame(rows, "City_ID string, Date date, PRESSURE_HPA double")
    stations = spark.createDataFrame(places, "station_id string, lat double, lon double")
    got = repair_gaps(df, stations, "PRESSURE_HPA").collect()
    assert sorted((str(r["City_ID"]), str(r["Date"]), r["PRESSURE_HPA"] or 0, r["ATMOSPHERE_IMPUTED"]) for r in got) == sorted(
        [("A", str(D), 7.0, 1.0)] * 2 + [("A", "None", 0, 0.0), ("None", str(D), 0, 0.0), ("B", str(D), 5.0, 0.0), ("B", str(D), 7.0, 0.0),
         ("C", str(D), 0, 0.0), ("X", str(D), 0, 0.0)])
    assert repair_gaps(df.limit(0), stations, "PRESSURE_HPA").count() == 0
    assert repair_gaps(df, stations.limit(0), "PRESSURE_HPA").filter("ATMOSPHERE_IMPUTED = 1").count() == 0


def test_rings_find_the_donors_of_whole_lists(spark):
    rng = random.Random(11)
    places = [(f"S{k:03d}", 40 + rng.randint(0, 30) / 20, -100 + rng.randint(0, 30) / 20) for k in range(120)]
    stations = spark.createDataFrame(places, "station_id string, lat double, lon double")
    # Day 0 is known nowhere, day 1 by one station, the others by more and more.
    data = [(s, date(2020, 1, 1) + timedelta(days=d), 1.0 if (rng.random() < d / 60 if d != 1 else s == "S007") else None)
            for s, *_ in places for d in range(30)]
    df = spark.createDataFrame(data, "City_ID string, Date date, PRESSURE_HPA double")
    words = day_words(df, "PRESSURE_HPA")
    assert ring_ends(stations, 150.0, 4) and not ring_ends(stations, 150.0, 1000)
    whole = {tuple(r) for r in chosen_donors(words, neighbour_lists(stations, 150.0), (8, 64)).collect()}
    ringed = donors_by_rings(words, stations, 150.0, (8, 64), crowd=4).collect()
    assert len(ringed) == len(whole) > 1000 and {tuple(r) for r in ringed} == whole


def test_far_stations_pair_only_while_gaps_are_open(spark):
    places = [(f"S{k:03d}", 40 + k % 20 / 10, -100 + k // 20 / 10) for k in range(400)]
    stations = spark.createDataFrame(places, "station_id string, lat double, lon double")
    ends = ring_ends(stations, 400.0)
    asking = stations.filter("station_id = 'S000'").selectExpr("station_id AS City_ID")
    assert ends and neighbour_lists(stations, 400.0, upto=ends[0]).count() < neighbour_lists(stations, 400.0).count() / 2
    assert neighbour_lists(stations, 400.0, asking, beyond=ends[0]).select("City_ID").distinct().count() == 1


def test_radius_pairs_are_reduced_where_they_are_made(spark, capsys):
    """Between the join of events with stations and the nearest of each station, day and type nothing is shuffled or written."""
    events = [(D + timedelta(days=k % 5), 10.0 + k / 1000, 20.0, f"t{k % 2}") for k in range(500)]
    stations = spark.createDataFrame([(f"S{i}", 10.0, 20.0 + i / 100) for i in range(40)] + [("S0", 30.0, 20.0)], "station_id string, lat double, lon double")
    before = set(glob.glob(f"{shared_folder(spark)}/*"))
    found = label_by_radius(spark.createDataFrame(events, "Date date, lat double, lon double, event_type string"), stations, km=150.0)
    assert found.count() == 200 and set(glob.glob(f"{shared_folder(spark)}/*")) == before
    found.explain()
    above = capsys.readouterr().out.split("SortMergeJoin")[0]
    assert above.count("Exchange") == 1 and above.count("partial_min(km") == 2


def test_distances_are_computed_once_a_place_and_station(spark):
    events = [(D + timedelta(days=k % 400), 10.0 + k % 3, 20.0, f"t{k % 2}") for k in range(4000)]
    events += [(D, None, 20.0, "nowhere")]
    stations = spark.createDataFrame([("A", 10.0, 20.5), ("B", 12.1, 20.0), ("C", None, 1.0)], "station_id string, lat double, lon double")
    df = spark.createDataFrame(events, "Date date, lat double, lon double, event_type string")
    places = place_dictionary(df, stations, 150.0)
    assert places.count() == places.select("place", "station").distinct().count() == 4
    got = label_by_radius(df, stations, km=150.0).collect()
    assert len(got) == 800 and {r["City_ID"] for r in got} == {"A", "B"}


@pytest.mark.parametrize("before,after,ambiguous", [(6, 6, 12), (1, 9, 12), (0, 3, 2)])
def test_chip_labels_match_brute_force(spark, before, after, ambiguous):
    rng = random.Random(8)
    start = datetime(2022, 5, 1)
    moment = lambda: start + timedelta(minutes=rng.randint(0, 20 * 24 * 60))
    chips = [(i, rng.choice("AAAB"), moment()) for i in range(400)]
    events = [(rng.choice("AAC"), moment()) for _ in range(15)] + [("A", chips[0][2]), ("A", chips[1][2])]
    got = label_chips(
        spark.createDataFrame(chips, "chip_id int, City_ID string, ts timestamp_ntz"),
        spark.createDataFrame(events, "City_ID string, ts timestamp_ntz"), before, after, ambiguous,
    ).collect()
    want = {}
    for i, s, t in chips:
        gaps = [(t - e).total_seconds() / 3600 for x, e in events if x == s]
        if any(-before <= g <= after for g in gaps):
            want[i] = 1
        else:
            want[i] = -1 if any(abs(g) <= ambiguous for g in gaps) else 0
    assert {r["chip_id"]: r["label"] for r in got} == want


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_chip_gap_ignores_the_session_zone(spark, kind):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = lambda text: f"CAST('{text}' AS {kind})"
        zone = "" if kind == "timestamp_ntz" else "Z"
        chips = spark.sql(f"SELECT 1 chip_id, 'A' City_ID, {at('2022-03-13 10:00:00.25' + zone)} ts")
        events = spark.sql(f"SELECT 'A' City_ID, {at('2022-03-13 04:00:00.25' + zone)} ts")
        got = label_chips(chips, events, 6, 6, 12).first()
        assert (got["label"], got["gap_hours"]) == (1, 6.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
