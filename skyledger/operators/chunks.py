"""Ordered per-station work without one task per station.

A station's history is cut into chunks of a few calendar years. Windows run per (station, chunk), so
one station that holds a large share of all rows still spreads over many tasks, and a group holds at
most one row per day of its years. Row frames that look back over a chunk boundary see copies of exactly the rows they need (``with_neighbours``); values
that travel any distance are carried over a table with one row per (station, chunk) (``carry``);
station totals are joined back on (station, chunk), which keeps the panel where it is
(``attach``).
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.schema import DAY, STATION

CHUNK = "_chunk"
COPY = "_copy"


CHUNK_YEARS = 4


def chunk_of(day: str = DAY) -> Column:
    return F.coalesce(F.floor(F.year(day) / CHUNK_YEARS).cast("int"), F.lit(0))


def with_chunk(df: DataFrame, day: str = DAY) -> DataFrame:
    return df.withColumn(CHUNK, chunk_of(day))


def chunk_window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def with_neighbours(df: DataFrame, before: int, after: int = 0, keys=(STATION,), order=(DAY,)) -> DataFrame:
    """Add, to every chunk, copies of the ``before`` rows ahead of it and ``after`` rows behind it.

    Copies carry ``_copy`` = true and are to be dropped after the window. ``after`` may not exceed
    ``max(before, 1)``. Only the rows at chunk ends pass through the per-key window that finds
    their targets: at most ``before + after`` rows per key and chunk, whatever the key's share.
    """
    keys, order = list(keys), list(order)
    if after > max(before, 1):
        raise ValueError("after may not exceed max(before, 1)")
    home = df.repartition(*keys, CHUNK)
    place = chunk_window(keys, order)
    # A row is among the last (first) rows of its chunk when none lies that far behind (ahead of) it.
    ends = (
        home.withColumn("_tail", F.lead(F.lit(1), max(before, 1)).over(place).isNull())
        .withColumn("_head", F.lag(F.lit(1), max(after, 1)).over(place).isNull())
        .filter(F.col("_tail") | F.col("_head"))
    )
    along = Window.partitionBy(*keys).orderBy(*order)
    own, none = F.col(CHUNK), F.array().cast("array<int>")
    furthest = F.max(CHUNK).over(along.rowsBetween(1, max(before, 1)))
    nearest = F.min(CHUNK).over(along.rowsBetween(-max(after, 1), -1))
    later, earlier = none, none
    if before:
        later = F.when(F.col("_tail") & (furthest > own), F.sequence(own + 1, furthest)).otherwise(none)
    if after:
        earlier = F.when(F.col("_head") & (nearest < own), F.sequence(nearest, own - 1)).otherwise(none)
    copies = (
        ends.withColumn("_targets", F.concat(later, earlier))
        .withColumn(CHUNK, F.explode("_targets"))
        .select(*df.columns, F.lit(True).alias(COPY))
        .repartition(*keys, CHUNK)
    )
    return home.withColumn(COPY, F.lit(False)).select(*df.columns, COPY).unionByName(copies)


def over_rows(
    df: DataFrame, columns: dict[str, Column], before: int, after: int = 0, keys=(STATION,), order=(DAY,)
) -> DataFrame:
    """Evaluate window columns written over ``chunk_window`` and drop the copies."""
    ready = with_neighbours(df, before, after, keys, order)
    return ready.withColumns(columns).filter(~F.col(COPY)).drop(COPY)


def spread(stats: DataFrame, first: str = "_first", last: str = "_last") -> DataFrame:
    """One row per key -> one row per (key, chunk) over the key's own chunks."""
    return stats.withColumn(CHUNK, F.explode(F.sequence(first, last))).drop(first, last)


def attach(df: DataFrame, stats: DataFrame, keys=(STATION,)) -> DataFrame:
    """Left-join per-key values on (key, chunk). ``stats`` holds the key's ``_first`` and ``_last`` chunk."""
    return df.join(spread(stats), [*keys, CHUNK], "left")


def chunk_bounds() -> list[Column]:
    return [F.min(CHUNK).alias("_first"), F.max(CHUNK).alias("_last")]


def chunk_ends(df: DataFrame, columns: list[str], keys=(STATION,), order=(DAY,)) -> DataFrame:
    """One row per key and chunk: the last known value of earlier chunks (``_from_<c>``), the first one of later chunks (``_to_<c>``)."""
    keys, order = list(keys), list(order)
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    known = {c: F.when(F.col(c).isNotNull(), rank) for c in columns}
    ends = df.groupBy(*keys, CHUNK).agg(
        *[F.max_by(c, known[c]).alias(f"_tail_{c}") for c in columns],
        *[F.min_by(c, known[c]).alias(f"_head_{c}") for c in columns],
    )
    ahead = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        *keys,
        CHUNK,
        *[F.last(f"_tail_{c}", True).over(ahead).alias(f"_from_{c}") for c in columns],
        *[F.last(f"_head_{c}", True).over(behind).alias(f"_to_{c}") for c in columns],
    )


def with_sides(df: DataFrame, columns: list[str], keys=(STATION,), order=(DAY,)) -> DataFrame:
    """Add the last known value up to each row (``_prev_<c>``) and the first one from it on (``_next_<c>``).

    Inside a chunk a window finds them; across chunks they come from a table with one row per key
    and chunk.
    """
    keys, order = list(keys), list(order)
    # Both directions run as growing frames: a frame that reaches to the chunk's end would be
    # evaluated again from every row.
    running = (Window.unboundedPreceding, 0)
    upto = chunk_window(keys, order).rowsBetween(*running)
    onward = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(*running)
    sides = {f"_prev_{c}": F.coalesce(F.last(c, True).over(upto), F.col(f"_from_{c}")) for c in columns}
    sides |= {f"_next_{c}": F.coalesce(F.last(c, True).over(onward), F.col(f"_to_{c}")) for c in columns}
    joined = df.join(chunk_ends(df, columns, keys, order), [*keys, CHUNK], "left").withColumns(sides)
    return joined.drop(*[f"_{p}_{c}" for c in columns for p in ("from", "to")])


def carry(df: DataFrame, columns: list[str], keys=(STATION,), order=(DAY,)) -> DataFrame:
    """Fill nulls from the last earlier value, then from the first later one, over any distance.

    A row without an earlier value in its chunk has its first later one where the chunk has its first, so one sort by
    the chunk's order serves both directions. The values of other chunks are joined after it: no sort holds them.
    """
    keys, order = list(keys), list(order)
    place = chunk_window(keys, order)
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = {f"_prev_{c}": F.last(c, True).over(upto) for c in columns}
    near |= {f"_first_{c}": F.first(c, True).over(whole) for c in columns}
    joined = df.withColumns(near).join(chunk_ends(df, columns, keys, order), [*keys, CHUNK], "left")
    filled = joined.withColumns({c: F.coalesce(f"_prev_{c}", f"_from_{c}", f"_first_{c}", f"_to_{c}") for c in columns})
    return filled.drop(*[f"_{p}_{c}" for c in columns for p in ("prev", "from", "first", "to")])


def join_by_station(df: DataFrame, table: DataFrame, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join a per-station table to rows of any number per station.

    Rows of one station are divided by day into ``salts`` parts, each of which meets a copy of the
    station's row.
    """
    left = df.withColumn("_salt", F.pmod(F.xxhash64(DAY), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [STATION, "_salt"], how).drop("_salt")
