"""Distance joins: event labels by radius, and gap repair from the nearest station.

Places meet in the cells of a grid. Events are reduced to the nearest of each station, day and type in the task that
pairs them; in gap repair days come in after the distances, by equi-joins and bitmaps.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.functions.geo import Grid, haversine_km
from skyledger.operators.lineage import settle
from skyledger.schema import DAY, STATION

SALTS = 16
#: Days of a bitmap word.
WORD = 64
#: Stations of the fullest cell from which the search for neighbours starts with a smaller radius.
CROWD = 64


def within_km(places: DataFrame, stations: DataFrame, km: float) -> DataFrame:
    """(columns of ``places``, station, km) for stations within ``km`` of the ``lat``, ``lon`` of a place; a null is near nothing."""
    grid = Grid(km)
    spots = places.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumn("cell", F.explode(grid.around(F.col("lat"), F.col("lon"))))
    marks = stations.select(
        F.col("station_id").alias("station"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
        grid.cell(F.col("lat"), F.col("lon")).alias("cell"))
    far = haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    return spots.join(marks, "cell").withColumn("km", far).filter(F.col("km") <= km).drop("cell", "_lat", "_lon")


def place_dictionary(events: DataFrame, stations: DataFrame, km: float) -> DataFrame:
    """(place, lat, lon, station, km): every distinct event place with the stations near it, each distance once."""
    places = events.select("lat", "lon").distinct()
    return within_km(places, stations, km).withColumn("place", F.xxhash64("lat", "lon"))


def label_by_radius(events: DataFrame, stations: DataFrame, km: float = 100.0, salts: int = SALTS) -> DataFrame:
    """Station-days with an event within ``km``: label 1, distinct types, nearest distance.

    Events of one day, place and type count once. Each goes to the cells that its radius touches; a cell's days are dealt
    into ``salts`` parts, each of which meets a copy of the cell's stations. An event and a station meet only inside a
    task, which keeps the nearest event of each station, day and type: no pair is written or shuffled.
    """
    grid, part = Grid(km), F.pmod(F.xxhash64(DAY), F.lit(salts)).cast("int")
    days = events.filter("lat IS NOT NULL AND lon IS NOT NULL").select(DAY, "lat", "lon", "event_type").distinct().select(
        "*", part.alias("part"), F.explode(grid.around(F.col("lat"), F.col("lon"))).alias("cell")).select("*", "cell.*").drop("cell")
    marks = stations.select(
        F.col("station_id").alias("station"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
        grid.cell(F.col("lat"), F.col("lon")).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part")
    ).select("*", "cell.*").drop("cell")
    keys = ["row", "column", "part"]
    far = haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    # Grouped by the keys of the join as well, the rows stay where the join has put them.
    nearest = days.join(marks.hint("merge"), keys).withColumn("km", far).filter(F.col("km") <= km).groupBy(
        *keys, DAY, "station", "event_type").agg(F.min("km").alias("km"))
    return nearest.groupBy(DAY, F.col("station").alias(STATION)).agg(
        F.lit(1).alias("EVENT_LABEL"),
        F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("EVENT_TYPE"),
        F.min("km").alias("EVENT_DISTANCE_KM"),
    )


def neighbour_lists(
    stations: DataFrame, km: float, asking: DataFrame | None = None, beyond: float | None = None, upto: float | None = None
) -> DataFrame:
    """(station, donor, km, place): all other stations within ``km``, ranked from the nearest; ties by station id.

    ``asking`` are the stations that need a list. The distance in the order of the lists lies over ``beyond`` and is at
    most ``upto``, so that the lists of adjoining rings are parts of one list.
    """
    order, rank = Window.partitionBy(STATION).orderBy(F.round("km", 6), "station"), F.round("km", 6)
    places = stations.select(F.col("station_id").alias(STATION), "lat", "lon")
    places = places if asking is None else places.join(asking, STATION, "left_semi")
    pairs = within_km(places, stations, km if upto is None else min(km, upto + 1e-3))
    pairs = pairs if beyond is None else pairs.filter(rank > beyond)
    pairs = pairs if upto is None else pairs.filter(rank <= upto)
    return pairs.filter(F.col("station") != F.col(STATION)).select(
        STATION, F.col("station").alias("donor"), "km", F.row_number().over(order).alias("place"))


def ring_ends(stations: DataFrame, km: float, crowd: int = CROWD) -> list[float]:
    """Radii below ``km``, each half of the next, down to one whose circle holds about ``crowd`` stations where they are densest."""
    cells = stations.groupBy(Grid(km).cell(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    fullest = cells.agg(F.max("n")).first()[0] or 0
    halvings = math.ceil(math.log(max(fullest / crowd, 1.0), 4))
    return [km / 2 ** k for k in range(halvings, 0, -1)]


def day_words(df: DataFrame, column: str) -> DataFrame:
    """(station, word, known, gaps): days of 64 as bits, of rows with a value and of rows without one."""
    day = F.datediff(DAY, F.lit("1970-01-01").cast("date"))
    bit = F.expr("shiftleft(1L, _bit)")
    return (
        df.filter(F.col(STATION).isNotNull() & F.col(DAY).isNotNull())
        .select(STATION, F.floor(day / WORD).cast("int").alias("word"), F.pmod(day, F.lit(WORD)).alias("_bit"), column)
        .groupBy(STATION, "word").agg(
            F.coalesce(F.bit_or(F.when(F.col(column).isNotNull(), bit)), F.lit(0).cast("long")).alias("known"),
            F.coalesce(F.bit_or(F.when(F.col(column).isNull(), bit)), F.lit(0).cast("long")).alias("gaps"))
    )


def both(a: str | Column, b: Column) -> Column:
    return (F.col(a) if isinstance(a, str) else a).bitwiseAND(b)


def chosen_donors(words: DataFrame, lists: DataFrame, bands: tuple[int, ...]) -> DataFrame:
    """(station, day, donor, km): for each gap the first neighbour on the station's list that knows the day.

    Whole words walk the list: a neighbour takes the gaps of a word that it knows and that none before it knows. The
    walk goes in bands of the list, so only words with open gaps meet the farther neighbours. A gap and a donor meet
    in a row of their own only where the donor is the chosen one.
    """
    return as_days(walked(known_words(words), open_words(words), lists, bands)[0])


def known_words(words: DataFrame) -> DataFrame:
    return words.filter("known <> 0").select(F.col(STATION).alias("donor"), "word", "known")


def open_words(words: DataFrame) -> DataFrame:
    return words.filter("gaps <> 0").select(STATION, "word", "gaps")


def walked(known: DataFrame, open_: DataFrame, lists: DataFrame, bands: tuple[int, ...], rest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what each neighbour of the lists takes of the open words, the words open after them); the latter is current with ``rest`` only."""
    longest = lists.agg(F.max("place")).first()[0] or 0
    before = Window.partitionBy(STATION, "word").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    found, first = None, 0
    for last in (*[b for b in bands if b < longest], longest):
        band = lists.filter((F.col("place") > first) & (F.col("place") <= last))
        met = open_.join(band, STATION).join(known, ["donor", "word"])
        taken = F.coalesce(F.bit_or("known").over(before), F.lit(0).cast("long"))
        hits = settle(
            met.withColumn("take", both(both("gaps", F.col("known")), F.bitwise_not(taken))).filter("take <> 0")
            .select(STATION, "word", "donor", "km", "take"), "donors")
        found = hits if found is None else found.unionByName(hits)
        if last < longest or rest:
            done = hits.groupBy(STATION, "word").agg(F.bit_or("take").alias("done"))
            open_ = settle(
                open_.join(done, [STATION, "word"], "left")
                .withColumn("gaps", both("gaps", F.bitwise_not(F.coalesce("done", F.lit(0).cast("long"))))).filter("gaps <> 0")
                .select(STATION, "word", "gaps"), "open")
        first = last
    return found, open_


def as_days(found: DataFrame) -> DataFrame:
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("take", i) == 1)
    return found.withColumn("_bit", F.explode(bits)).select(
        STATION, F.date_add(F.lit("1970-01-01").cast("date"), F.col("word") * WORD + F.col("_bit")).alias(DAY), "donor", "km")


def donors_by_rings(words: DataFrame, stations: DataFrame, km: float, bands: tuple[int, ...], crowd: int = CROWD) -> DataFrame:
    """What ``chosen_donors`` finds on the lists of all neighbours, which are made ring by ring.

    Only stations with open gaps get the neighbours of the next, wider ring, so dense stations do not pair with all
    others within ``km``. Gaps of days that no station knows are left out at once.
    """
    known = known_words(words)
    # One row for each 64 days of the calendar.
    anywhere = F.broadcast(known.groupBy("word").agg(F.bit_or("known").alias("_any")))
    open_ = settle(open_words(words).join(anywhere, "word").withColumn("gaps", both("gaps", F.col("_any"))).filter("gaps <> 0")
                   .select(STATION, "word", "gaps"), "open")
    found, beyond = None, None
    for upto in (*ring_ends(stations, km, crowd), None):
        if found is not None and open_.isEmpty():
            break
        lists = settle(neighbour_lists(stations, km, open_.select(STATION).distinct(), beyond, upto), "neighbours")
        hits, open_ = walked(known, open_, lists, bands, rest=upto is not None)
        found = hits if found is None else found.unionByName(hits)
        beyond = upto
    return as_days(found)


def repair_gaps(
    df: DataFrame, stations: DataFrame, column: str, max_km: float = 150.0, bands: tuple[int, ...] = (8, 64)
) -> DataFrame:
    """Fill nulls of ``column`` from the nearest station that has a value on the same day; ties by station id.

    Each station has a ranked list of its neighbours and a bitmap of the days that it knows; see ``donors_by_rings``. The
    value of the chosen donor is looked up by station and day. Rows without a station or day stay as they are; of
    several values of a donor on one day the largest is taken.
    """
    words = settle(day_words(df, column), "words")
    values = df.filter(F.col(column).isNotNull()).select(F.col(STATION).alias("donor"), DAY, F.col(column).alias("_value"))
    fills = donors_by_rings(words, stations, max_km, bands).join(values, ["donor", DAY]).groupBy(STATION, DAY).agg(
        F.max("_value").alias("_value"), F.first("km").alias("_km"))
    joined = df.drop("ATMOSPHERE_IMPUTED", "ATMOSPHERE_DONOR_KM").join(fills, [STATION, DAY], "left")
    imputed = F.col(column).isNull() & F.col("_value").isNotNull()
    return joined.withColumns({
        "ATMOSPHERE_IMPUTED": F.when(imputed, 1.0).otherwise(0.0),
        "ATMOSPHERE_DONOR_KM": F.when(imputed, F.col("_km")).otherwise(0.0),
        column: F.coalesce(column, "_value"),
    }).drop("_value", "_km")
