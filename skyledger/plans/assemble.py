"""Panel assembly: all auxiliary joins in two shuffles of the panel.

Every join on (station, day) comes first and shares one partitioning. Per-station facts (soil
presence, label coverage, basin, coordinates) are collected into one small table and attached
together on (station, chunk), the partitioning the carries and windows after it use as well. Series
by day are broadcast.
"""

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.hazards import ocean_basin
from skyledger.operators.chunks import CHUNK, attach, carry, chunk_bounds, chunk_of, with_chunk
from skyledger.operators.cleaning import derive_tavg, soil_observed
from skyledger.operators.enrichment import (
    basin_series, join_atmosphere, join_event_labels, label_period, one_per_key, per_day,
)
from skyledger.schema import DAY, INDICES, SOIL, SST_FILL_C, STATION


def assemble(
    panel: DataFrame,
    stations: DataFrame | None = None,
    atmosphere: DataFrame | None = None,
    soil: DataFrame | None = None,
    indices: DataFrame | None = None,
    sst: DataFrame | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    base = derive_tavg(panel)
    facts = base.select(STATION, chunk_of().alias(CHUNK)).groupBy(STATION).agg(*chunk_bounds())

    if atmosphere is not None:
        base = join_atmosphere(base, atmosphere)
    if soil is not None:
        kept = [c for c in SOIL if c in soil.columns]
        right = one_per_key(soil_observed(soil.select(STATION, DAY, *kept)), [STATION, DAY])
        base = base.drop(*SOIL, "SOIL_MOISTURE_OBSERVED").join(right, [STATION, DAY], "left")
        facts = facts.join(soil.select(STATION).distinct().withColumn("_has_soil", F.lit(True)), STATION, "left")
    elif "SOIL_MOISTURE_OBSERVED" not in base.columns:
        base = base.withColumn("SOIL_MOISTURE_OBSERVED", F.lit(0.0))
    base = join_event_labels(base, labels)
    if labels is not None:
        facts = facts.join(labels.select(STATION).distinct().withColumn("_covered", F.lit(True)), STATION, "left")
    if stations is not None:
        places = one_per_key(
            stations.select(F.col("station_id").alias(STATION), F.col("lat").alias("LATITUDE"),
                            F.col("lon").alias("LONGITUDE"), F.col("elevation").alias("ELEVATION")), [STATION])
        base = base.drop("LATITUDE", "LONGITUDE", "ELEVATION")
        facts = facts.join(places, STATION, "left")
        basin = ocean_basin(F.col(STATION), F.col("LATITUDE"), F.col("LONGITUDE"))
    else:
        nowhere = F.lit(None).cast("double")
        basin = ocean_basin(F.col(STATION), nowhere, nowhere)
    facts = facts.withColumn("_basin", F.coalesce(basin, F.lit("mean")))

    base = attach(with_chunk(base), facts)
    carried = []
    if indices is not None:
        names = [c for c in INDICES if c in indices.columns]
        base = base.drop(*names).join(per_day(indices.select(DAY, *names)), DAY, "left")
        seen = F.coalesce(*[F.col(c) for c in names]).isNotNull()
        base = base.withColumn("CLIMATE_INDEX_OBSERVED", F.when(seen, 1.0).otherwise(0.0))
        carried += names
    if sst is not None:
        series = basin_series(sst)
        averages = series.groupBy("basin").agg(F.avg("_sst").alias("_sst_mean"))
        # At most four basins per calendar day.
        by_day = F.broadcast(series.withColumnRenamed("basin", "_basin"))
        base = base.drop("SST").join(by_day, [DAY, "_basin"], "left")
        base = base.join(F.broadcast(averages.withColumnRenamed("basin", "_basin")), "_basin", "left")
        carried.append("_sst")
    if carried:
        base = carry(base, carried)
    base = base.withColumn("SST", F.coalesce("_sst", "_sst_mean", F.lit(SST_FILL_C)) if sst is not None else F.lit(SST_FILL_C))
    if soil is not None:
        flag = F.when(F.col("_has_soil"), F.col("SOIL_MOISTURE_OBSERVED")).otherwise(F.lit(0.0))
        base = base.withColumn("SOIL_MOISTURE_OBSERVED", flag)
    if labels is not None:
        period = label_period(labels)
        inside = F.coalesce(F.col("_covered") & F.col(DAY).between(period["first"], period["last"]), F.lit(False))
        base = base.withColumns({
            "EVENT_LABEL": F.when(inside, F.coalesce("EVENT_LABEL", F.lit(0.0))).otherwise(F.col("EVENT_LABEL")),
            "EVENT_LABEL_AVAILABLE": F.when(inside, F.lit(1)).otherwise(F.col("EVENT_LABEL_AVAILABLE")),
        })
    return base.drop("_has_soil", "_covered", "_basin", "_sst", "_sst_mean", CHUNK)
