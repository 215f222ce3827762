"""Times the headline queries; prints one JSON line.

Every query runs over its whole tables and is written to a sink that takes all rows. The station
archive that the queries read is derived first and timed as ``archive``.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from skyledger.registry import QUERIES
from skyledger.registry.proxies import Tables

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "assemble_panel", "feature_panel", "hazard_days", "rolling_rain_sums", "rolling_anomalies", "drought_index",
    "station_quantiles", "hazard_shares", "monthly_summary", "annual_summary", "station_profile", "correlation_matrix",
    "fill_sst", "label_coverage", "label_by_radius", "repair_gaps", "label_chips", "sequences_30",
    "chronological_split", "roc_auc", "average_precision", "tune_threshold", "recent_features",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables, seconds = Tables(spark, FOLDER), {}
    start = time.time()
    for name in ("obs", "atmosphere", "soil", "indices", "sst"):
        getattr(tables, name)()
    seconds["archive"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name].build(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
