"""Exact classification and regression metrics as aggregations.

Scores are reduced to distinct values or bins before anything is ordered, so no metric sorts raw
rows in one task.
"""

from pyspark.sql import DataFrame, Window, functions as F

from skyledger.functions.columns import flag
from skyledger.operators.ranks import running_levels


def tune_threshold(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Threshold of 0.05, 0.06, .. 0.95 with the best F1, the lowest of equals; (0.5, 0) for one class."""
    bins = F.floor((F.col(score) - 0.05 + 1e-9) * 100).cast("int")
    histogram = df.groupBy(F.greatest(F.lit(-1), F.least(bins, F.lit(90))).alias("bin")).agg(
        F.sum(y).cast("long").alias("pos"), F.count(F.lit(1)).alias("n")
    )
    spine = df.sparkSession.range(-1, 91, 1, 1).select(F.col("id").cast("int").alias("bin"))
    # 92 rows from here on.
    down = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    counted = spine.join(histogram, "bin", "left").select(
        "bin",
        F.sum(F.coalesce("pos", F.lit(0))).over(down).alias("tp"),
        F.sum(F.coalesce("n", F.lit(0))).over(down).alias("called"),
        F.sum(F.coalesce("pos", F.lit(0))).over(whole).alias("positives"),
        F.sum(F.coalesce("n", F.lit(0))).over(whole).alias("n"),
    )
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("called") + F.col("positives")), F.lit(0.0))
    scored = counted.filter("bin >= 0").select(
        (F.lit(5) + F.col("bin")).alias("_pct"), f1.alias("f1"),
        ((F.col("positives") == 0) | (F.col("positives") == F.col("n"))).alias("one_class"),
    )
    best = scored.orderBy(F.col("f1").desc(), "_pct").limit(1)
    return best.select(
        F.when(F.col("one_class"), F.lit(0.5)).otherwise(F.col("_pct") / 100.0).alias("threshold"),
        F.when(F.col("one_class"), F.lit(0.0)).otherwise(F.col("f1")).alias("f1"),
    )


def classification_metrics(df: DataFrame, y: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and positive rate; a zero division gives 0."""
    truth, called = F.col(y) == 1, F.col(predicted) == 1
    cells = df.groupBy(*(keys or [])).agg(
        F.count_if(truth & called).alias("tp"), F.count_if(~truth & called).alias("fp"),
        F.count_if(truth & ~called).alias("fn"), F.count_if(~truth & ~called).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top * 1.0, bottom), F.lit(0.0))

    return cells.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(tp * 2, tp * 2 + fp + fn),
        "positive_rate": ratio(tp + fn, tp + fp + fn + tn),
    })


def score_levels(df: DataFrame, y: str, score: str, keys: list[str]) -> DataFrame:
    return running_levels(
        df, keys, score, {"n": F.count(F.lit(1)), "pos": F.sum(F.col(y).cast("long"))}
    )


def ranking_metrics(df: DataFrame, y: str = "y", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """Tie-aware ROC AUC and step-wise average precision.

    One class gives AUC 0.5 and the positive share as average precision; no rows give 0.5 and 0.
    """
    keys = keys or []
    levels = score_levels(df, y, score, keys)
    neg, neg_below = F.col("n") - F.col("pos"), F.col("n_below") - F.col("pos_below")
    reached, called = F.col("pos_total") - F.col("pos_below"), F.col("n_total") - F.col("n_below")
    sums = levels.groupBy(*keys).agg(
        F.sum(F.col("pos") * (neg_below + neg * 0.5)).alias("_wins"),
        F.sum(F.col("pos") * F.try_divide(reached * 1.0, called)).alias("_steps"),
        F.max("pos_total").alias("positives"), F.max("n_total").alias("rows"),
    )
    negatives = F.col("rows") - F.col("positives")
    one_class = F.coalesce((F.col("positives") == 0) | (negatives == 0), F.lit(True))
    share = F.coalesce(F.try_divide(F.col("positives") * 1.0, F.col("rows")), F.lit(0.0))
    return sums.select(
        *keys,
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("positives", F.lit(0)).alias("positives"),
        F.when(one_class, F.lit(0.5)).otherwise(
            F.try_divide(F.col("_wins"), F.col("positives") * negatives)
        ).alias("roc_auc"),
        F.when(one_class, share).otherwise(F.try_divide(F.col("_steps"), F.col("positives"))).alias(
            "average_precision"
        ),
    )


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    return ranking_metrics(df, y, score, keys).drop("average_precision")


def average_precision(df: DataFrame, y: str = "y", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    return ranking_metrics(df, y, score, keys).drop("roc_auc")


def regression_metrics(df: DataFrame, y: str, predicted: str, low: float = 0.0, span: float = 1.0) -> DataFrame:
    """Scaled MSE and R2, MAE and RMSE after undoing the scaling; one aggregation."""
    error = F.col(y) - F.col(predicted)
    raw = (F.col(y) * span + low) - (F.col(predicted) * span + low)
    known = df.filter(F.col(y).isNotNull() & F.col(predicted).isNotNull())
    return known.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(error * error).alias("mse_scaled"),
        # A constant truth scores 1 if it is met exactly and 0 otherwise.
        F.when(F.var_pop(y) > 0, F.lit(1.0) - F.try_divide(F.avg(error * error), F.var_pop(y)))
        .when(F.max(F.abs(error)) == 0, 1.0).when(F.max(F.abs(error)) > 0, 0.0).alias("r2"),
        F.avg(F.abs(raw)).alias("mae"),
        F.sqrt(F.avg(raw * raw)).alias("rmse"),
    )


def event_subset_metrics(
    df: DataFrame, score: str = "hazard_prob", label: str = "EVENT_LABEL", available: str = "EVENT_LABEL_AVAILABLE"
) -> DataFrame:
    """Hazard model against reported events on covered rows; no such rows give accuracy 0 and AUC 0.5."""
    covered = df.filter(F.coalesce(available, F.lit(0)) != 0).select(
        F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("y"), F.col(score).alias("score"),
        flag(F.col(score) > 0.5).alias("called"),
    )
    hits = covered.agg(
        F.coalesce(F.avg((F.col("y") == F.col("called")).cast("double")), F.lit(0.0)).alias("accuracy")
    )
    ranked = ranking_metrics(covered).select("rows", "roc_auc")
    # Two one-row results side by side.
    return ranked.withColumn("accuracy", hits.scalar())
