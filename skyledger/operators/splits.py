"""Chronological splits, scaling and class weights."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from skyledger.operators.ranks import running_levels
from skyledger.schema import DAY

# Calendar boundaries of the full archive and of the event-label years.
ARCHIVE_START, ARCHIVE_END = "1995-01-01", "2024-01-01"
VALIDATION_FROM, TEST_FROM = "2019-01-01", "2022-01-01"
EVENT_VALIDATION_FROM, EVENT_TEST_FROM = "2023-01-01", "2024-01-01"


class SmallSplit(ValueError):
    """A split holds too few rows."""


def by_dates(day, validation_from: str, test_from: str):
    return (
        F.when(day < F.to_date(F.lit(validation_from)), F.lit("train"))
        .when(day < F.to_date(F.lit(test_from)), F.lit("validation"))
        .otherwise(F.lit("test"))
    )


def chronological_split(df: DataFrame, train_pct: int = 70, validation_pct: int = 15) -> DataFrame:
    """``split`` per row: fixed boundaries for the full archive, else shares of the rows in date order.

    Whole days stay together, so no split overlaps another in time. A row without a day stays, in no split.
    """
    return with_splits(df, day_splits(df, train_pct, validation_pct))


def with_splits(df: DataFrame, cuts: DataFrame) -> DataFrame:
    # One row per calendar day.
    return df.join(F.broadcast(cuts), DAY, "left")


def day_splits(df: DataFrame, train_pct: int = 70, validation_pct: int = 15) -> DataFrame:
    """(Date, split) for each day of the rows; the table is bounded by the calendar."""
    days = df.filter(F.col(DAY).isNotNull()).select(F.unix_date(DAY).alias("_day"))
    levels = running_levels(days, [], "_day", {"n": F.count(F.lit(1))})
    span = df.agg(F.struct(F.min(DAY).alias("first"), F.max(DAY).alias("last"))).scalar()
    whole = (span["first"] <= F.to_date(F.lit(ARCHIVE_START))) & (span["last"] >= F.to_date(F.lit(ARCHIVE_END)))
    day = F.date_from_unix_date("_day")
    train_end = F.floor(F.col("n_total") * train_pct / 100)
    validation_end = F.floor(F.col("n_total") * (train_pct + validation_pct) / 100)
    by_share = (
        F.when(F.col("n_below") < train_end, F.lit("train"))
        .when(F.col("n_below") < validation_end, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return levels.select(
        day.alias(DAY), F.when(whole, by_dates(day, VALIDATION_FROM, TEST_FROM)).otherwise(by_share).alias("split")
    )


def require_splits(df: DataFrame, minimum: int = 31) -> DataFrame:
    """Raise unless train, validation and test each hold ``minimum`` rows."""
    sizes = {r["split"]: r["rows"] for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).collect()}
    short = [s for s in ("train", "validation", "test") if sizes.get(s, 0) < minimum]
    if short:
        raise SmallSplit(f"too few rows in: {', '.join(short)}")
    return df


def event_split(df: DataFrame, validation_from=EVENT_VALIDATION_FROM, test_from=EVENT_TEST_FROM) -> DataFrame:
    """Rows under label coverage, split by year; a missing label counts as no event."""
    covered = df.filter(F.coalesce("EVENT_LABEL_AVAILABLE", F.lit(0)) != 0)
    return covered.withColumns({
        "EVENT_LABEL": F.coalesce(F.col("EVENT_LABEL").cast("int"), F.lit(0)),
        "split": by_dates(F.col(DAY), validation_from, test_from),
    })


def event_readiness(events: DataFrame, minimum: int = 30) -> DataFrame:
    """One row: whether the event model can be trained, the reason if not, and the split sizes."""
    def rows(split):
        return F.count_if(F.col("split") == split)

    sizes = events.agg(
        F.count(F.lit(1)).alias("rows"),
        rows("train").alias("train_rows"), rows("validation").alias("validation_rows"), rows("test").alias("test_rows"),
        F.countDistinct(F.when(F.col("split") == "train", F.col("EVENT_LABEL"))).alias("train_classes"),
    )
    short = (F.least("train_rows", "validation_rows", "test_rows") < minimum) | (F.col("train_classes") < 2)
    return sizes.withColumns({
        "trained": ~((F.col("rows") == 0) | short),
        "reason": F.when(F.col("rows") == 0, F.lit("no event coverage rows"))
        .when(short, F.lit("event split too small or single class"))
        .otherwise(F.lit("")),
    })


@dataclass(frozen=True)
class MinMax:
    """Fitted column ranges; a constant column is only shifted."""

    low: dict[str, float]
    high: dict[str, float]

    def span(self, name: str) -> float:
        return (self.high[name] - self.low[name]) or 1.0

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        return df.withColumns({prefix + c: (F.col(c) - self.low[c]) / self.span(c) for c in self.low})

    def inverse(self, column, name: str):
        return column * self.span(name) + self.low[name]


def minmax_fit(df: DataFrame, columns: list[str]) -> MinMax:
    """Ranges of the given rows (the training split), from one aggregation."""
    row = df.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns],
    ).first()
    low = {c: row[f"lo_{c}"] for c in columns}
    empty = [c for c, v in low.items() if v is None]
    if empty:
        raise SmallSplit(f"no values to fit a range on: {', '.join(empty)}")
    return MinMax(low, {c: row[f"hi_{c}"] for c in columns})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes * n_class); one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    classes = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (classes * F.col("rows")))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    # Binary labels: two rows.
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label)
