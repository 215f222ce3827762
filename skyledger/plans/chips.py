"""Chip and tabular fusion: fit on the first period, tuned on the second, reported on the third."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from skyledger.functions.columns import flag
from skyledger.operators import learners as L
from skyledger.operators.lineage import settle
from skyledger.operators.metrics import classification_metrics, ranking_metrics, tune_threshold
from skyledger.operators.splits import EVENT_TEST_FROM, EVENT_VALIDATION_FROM, SmallSplit, by_dates, chronological_split
from skyledger.operators.timing import UNLABELLED, join_chip_tabular
from skyledger.schema import DAY

SPLITS = ("train", "validation", "test")


@dataclass
class ChipFusion:
    """The fitted fusion, its threshold, every evaluated chip with ``split``, ``score`` and ``called``, and the metrics."""

    model: PipelineModel
    threshold: float
    scored: DataFrame
    metrics: dict


def split_sizes(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """Rows and positives of each split; three rows come to the driver."""
    found = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives")).collect()
    return {r["split"]: (r["rows"], int(r["positives"])) for r in found}


def large_enough(sizes: dict[str, tuple[int, int]], minimum: int) -> bool:
    rows, positives = sizes.get("train", (0, 0))
    return all(sizes.get(s, (0, 0))[0] >= minimum for s in SPLITS) and 0 < positives < rows


def fuse_chips(
    chips: DataFrame, rates: DataFrame, validation_from: str = EVENT_VALIDATION_FROM, test_from: str = EVENT_TEST_FROM, minimum: int = 30
) -> ChipFusion:
    """Fusion of ``chip_prob`` of labelled chips with the station-day ``event_prob``.

    Chips in the ambiguous time, without a probability on either side, or on a station-day that ``rates`` lacks take no part.
    The splits follow the dates where each has ``minimum`` rows and the first has both classes, else shares of the
    chips in date order; if these are too small as well, ``SmallSplit`` is raised. The threshold is the one of best F1 on
    the second period and the metrics are those of the third, so neither has seen what it is measured on.
    """
    known = chips.filter((F.col("label") != UNLABELLED) & F.col("chip_prob").isNotNull() & ~F.isnan("chip_prob"))
    joined = join_chip_tabular(known.drop("split", "event_prob", "score", "called"), rates.dropna(subset=["event_prob"]))
    rows = settle(joined.withColumn("split", by_dates(F.col(DAY), validation_from, test_from)), "chips")
    strategy, sizes = "dates", split_sizes(rows)
    if not large_enough(sizes, minimum):
        rows = settle(chronological_split(rows.drop("split")), "chips")
        strategy, sizes = "shares", split_sizes(rows)
    if not large_enough(sizes, minimum):
        raise SmallSplit(f"too few labelled chips: {sizes}")
    model = L.chip_tabular_fusion(rows.filter("split = 'train'"))
    scored = settle(L.with_probability(rows, model, "score"), "fused-chips")
    best = tune_threshold(scored.filter("split = 'validation'"), "label").first()
    scored = scored.withColumn("called", flag(F.col("score") >= best["threshold"]))
    test = scored.filter("split = 'test'")
    cells, ranked = classification_metrics(test, "label", "called").first(), ranking_metrics(test, "label").first()
    metrics = {
        "split_strategy": strategy, "threshold": best["threshold"], "validation_f1": best["f1"],
        **{f"{s}_{part}": sizes[s][i] for s in SPLITS for i, part in enumerate(("rows", "positives"))},
        **{f"test_{m}": cells[m] for m in ("accuracy", "precision", "recall", "f1")},
        "test_auc": ranked["roc_auc"], "test_average_precision": ranked["average_precision"],
    }
    return ChipFusion(model, best["threshold"], scored, metrics)
