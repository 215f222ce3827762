"""Time-interval joins between image chips and reported events."""

from pyspark.sql import DataFrame, Window, functions as F

from skyledger.functions.columns import micros
from skyledger.operators.chunks import CHUNK, with_sides
from skyledger.schema import DAY, STATION

POSITIVE, NEGATIVE, UNLABELLED = 1, 0, -1


def label_chips(
    chips: DataFrame, events: DataFrame, before_hours: float = 6, after_hours: float = 6, ambiguous_hours: float = 12
) -> DataFrame:
    """1 inside [event - before, event + after], -1 within the ambiguous distance, else 0.

    Only the last event up to a chip and the first one after it can decide, so both sides are
    merged in time order and the neighbouring event times are carried along: no pair of chip and
    event is ever formed. The carry runs per (station, hour) plus one row per station and hour.
    """
    reports = events.select(STATION, "ts").distinct()
    kinds = [c for c in chips.columns if c not in (STATION, "ts")]
    images = chips.select(STATION, "ts", F.struct(*kinds).alias("_chip"), F.lit(1).alias("_kind"))
    merged = images.unionByName(reports.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    merged = merged.withColumns({
        "_event": F.when(F.col("_kind") == 0, F.col("ts")),
        CHUNK: F.date_trunc("hour", F.col("ts")),
    })
    order = ["ts", "_kind"]
    both = with_sides(merged, ["_event"], order=order)

    zoned = dict(chips.dtypes)["ts"] == "timestamp"

    def gap(later, earlier):
        return (micros(later, zoned) - micros(earlier, zoned)) / 3.6e9

    since, until = gap(F.col("ts"), F.col("_prev__event")), gap(F.col("_next__event"), F.col("ts"))
    nearest = F.least(since, until)
    hit = F.coalesce(since <= after_hours, F.lit(False)) | F.coalesce(until <= before_hours, F.lit(False))
    label = (
        F.when(hit, F.lit(POSITIVE))
        .when(F.coalesce(nearest <= ambiguous_hours, F.lit(False)), F.lit(UNLABELLED))
        .otherwise(F.lit(NEGATIVE))
    )
    return both.filter(F.col("_kind") == 1).select(
        STATION, "ts", "_chip.*", label.alias("label"), nearest.alias("gap_hours")
    )


def reported(labels: DataFrame) -> DataFrame:
    """Station-days with an event, once each: repeats are dropped before they are shuffled."""
    return labels.filter(F.col("EVENT_LABEL") == 1).select(STATION, DAY).distinct()


def event_dates(calendar: DataFrame, labels: DataFrame) -> DataFrame:
    """Station-days of the calendar with a reported event."""
    return calendar.join(reported(labels), [STATION, DAY], "left_semi")


def quiet_dates(calendar: DataFrame, labels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` station-days without an event, in a repeatable pseudo-random order."""
    free = calendar.join(reported(labels), [STATION, DAY], "left_anti")
    return free.orderBy(F.xxhash64(STATION, DAY, F.lit(seed)), STATION, DAY).limit(n)


def join_chip_tabular(chips: DataFrame, scores: DataFrame) -> DataFrame:
    """Chip probability next to the station-day event probability."""
    return chips.withColumn(DAY, F.to_date("ts")).join(scores, [STATION, DAY])


def event_rates(days: DataFrame, events: DataFrame) -> DataFrame:
    """``event_prob`` per station-day of ``days``: the share of earlier days on which the station reported an event.

    One day with and one without an event are added before dividing. A day sees only what was reported before it, so the
    rate may be used for any split. Days are counted from the first one of either table; rows without station or day go.
    """
    asked = days.select(STATION, DAY, F.lit(0).alias("_hit"), F.lit(1).alias("_asked"))
    hits = events.select(STATION, DAY, F.lit(1).alias("_hit"), F.lit(0).alias("_asked"))
    marks = asked.unionByName(hits).dropna(subset=[STATION, DAY]).groupBy(STATION, DAY).agg(
        F.max("_hit").alias("_hit"), F.max("_asked").alias("_asked"))
    # A station has one row for each day at most.
    before = Window.partitionBy(STATION).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    elapsed = F.datediff(F.col(DAY), marks.agg(F.min(DAY)).scalar())
    counted = marks.withColumn("event_prob", (F.coalesce(F.sum("_hit").over(before), F.lit(0)) + 1.0) / (elapsed + 2.0))
    return counted.filter("_asked = 1").select(STATION, DAY, "event_prob")
