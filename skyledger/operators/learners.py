"""Model jobs on MLlib: forests, fusion, next-day temperature, scoring and explanations."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.functions.columns import flag
from skyledger.functions.hazards import clamp_pct, risk_tier
from skyledger.operators.bootstrap import bootstrap_weights
from skyledger.operators.lineage import settle
from skyledger.operators.rolling import rolling
from skyledger.operators.splits import MinMax, with_class_weights
from skyledger.schema import DAY, FEATURES, SEQUENCE, STATION

SCALED = "_z_"
UNTRAINED_IMPORTANCE = 0.1
FUSION_RIDGE = 1e-4
#: Fits of one bag that run at a time; the levels of a small forest leave executors idle.
FITS = 4
#: The nodes that rows remember are kept with the rows; a checkpoint would write them to the shared folder as well, a number a row and tree.
NO_CHECKPOINT = -1


def assembler(columns: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep")


def scaled_names(columns: list[str]) -> list[str]:
    return [SCALED + c for c in columns]


def train_forest(
    scaled: DataFrame, label: str, columns: list[str], trees: int, depth: int, seed: int, min_leaf: int = 1
) -> PipelineModel:
    """Random forest on scaled features with balanced class weights."""
    weighted = with_class_weights(scaled.withColumn("label", F.col(label).cast("double")), "label")
    assemble = assembler(scaled_names(columns))
    rows = assemble.transform(weighted).select("features", "label", "weight")
    # Rows remember the nodes they have reached, so that no level walks each tree again from its root.
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed, weightCol="weight", cacheNodeIds=True,
        checkpointInterval=NO_CHECKPOINT)
    return PipelineModel([assemble, forest.fit(rows)])


def hazard_forest(scaled: DataFrame, columns: list[str] = FEATURES, trees: int = 100) -> PipelineModel:
    return train_forest(scaled, "RISK", columns, trees, depth=10, seed=42)


@dataclass
class Bag:
    """Forests whose probabilities are averaged."""

    models: list[PipelineModel]


def event_forest(
    scaled: DataFrame, columns: list[str] = FEATURES, trees: int = 100, bootstraps: int = 10, keys: tuple[str, ...] = (STATION, DAY)
) -> Bag:
    """Trees on bootstraps that each balance the classes by their own draw.

    The trees of one bootstrap differ by the features that their splits may use; ``bootstraps`` = ``trees`` gives every
    tree a draw of its own. The drawn rows of all bootstraps are written once, each bootstrap to a folder of its own, so
    that a fit reads its rows alone; ``FITS`` fits run at a time.
    """
    seed, label = 143, "EVENT_LABEL"
    bootstraps = min(bootstraps, trees)
    assemble = assembler(scaled_names(columns))
    rows = assemble.transform(scaled).select(*keys, label, "features")
    rows = bootstrap_weights(rows, label, list(keys), bootstraps, seed)
    rows = rows.select("bootstrap", F.col(label).cast("double").alias("label"), "features", "weight")
    rows = settle(rows, "bootstraps", by="bootstrap")

    def fit(b: int) -> PipelineModel:
        forest = RandomForestClassifier(
            numTrees=trees // bootstraps + (b < trees % bootstraps), maxDepth=12, minInstancesPerNode=3, seed=seed + b,
            weightCol="weight", bootstrap=False, featureSubsetStrategy="sqrt", cacheNodeIds=True,
            checkpointInterval=NO_CHECKPOINT)
        return PipelineModel([assemble, forest.fit(rows.filter(F.col("bootstrap") == b))])

    with ThreadPoolExecutor(FITS) as pool:
        models = list(pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(bootstraps)))
    return Bag(models)


def with_probability(df: DataFrame, model: PipelineModel | Bag, out: str) -> DataFrame:
    """Probability of class 1; the model's own columns are dropped. Forests of a bag with the same inputs share one vector."""
    if isinstance(model, Bag):
        parts, inputs = [f"_p{i}" for i in range(len(model.models))], None
        for part, one in zip(parts, model.models):
            assemble = one.stages[0]
            if assemble.getInputCols() != inputs:
                df, inputs = assemble.transform(df.drop("features")), assemble.getInputCols()
            df = with_chance(df, forest_of(one), part)
        # The forests of a bag may have one tree more or less; each counts by its trees.
        trees = [forest_of(m).getNumTrees for m in model.models]
        total = sum((F.col(p) * float(n) for p, n in zip(parts, trees)), F.lit(0.0))
        return df.withColumn(out, total / float(sum(trees))).drop("features", *parts)
    return with_chance(PipelineModel(model.stages[:-1]).transform(df), model.stages[-1], out).drop("features")


def with_chance(df: DataFrame, model, out: str) -> DataFrame:
    """Probability of class 1 from ``features``; raw votes and classes are not asked for."""
    scored = model.transform(df, {model.rawPredictionCol: "", model.predictionCol: ""})
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("probability")


def fusion_classifier(df: DataFrame, inputs: list[str], label: str, iterations: int = 50, seed: int = 7) -> PipelineModel:
    """Two inputs through layers of 16 and 8; fit on validation predictions only."""
    assemble = assembler(inputs)
    rows = assemble.transform(df.withColumn("label", F.col(label).cast("double"))).select("features", "label")
    net = MultilayerPerceptronClassifier(layers=[len(inputs), 16, 8, 2], maxIter=iterations, seed=seed)
    return PipelineModel([assemble, net.fit(rows)])


def window_vector(df: DataFrame, columns: list[str] = SEQUENCE) -> DataFrame:
    """The row's sequence of steps flattened into one feature vector."""
    flat = F.flatten(F.transform("sequence", lambda s: F.array(*[s[c] for c in columns])))
    return df.withColumn("window", array_to_vector(flat))


def next_day_temperature(windows: DataFrame, regularisation: float = 1e-3):
    """Regression of the scaled TAVG on the scaled 30-row window."""
    model = LinearRegression(
        featuresCol="window", labelCol="target", predictionCol="temp_pred", regParam=regularisation
    )
    return model.fit(windows.select("window", "target"))


def persistence_forecast(df: DataFrame, column: str = "TAVG") -> DataFrame:
    """Baseline: the next row repeats this row's value."""
    return rolling(df, [], {"target": column}).filter(F.col("target").isNotNull()).withColumn(
        "predicted", F.col(column)
    )


def feature_importances(spark: SparkSession, model: PipelineModel | None, columns: list[str] = FEATURES) -> DataFrame:
    """(feature, importance), ascending; an untrained model gives equal weights."""
    values = [UNTRAINED_IMPORTANCE] * len(columns) if model is None else list(forest_of(model).featureImportances.toArray())
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(float(v)).alias("importance")) for c, v in zip(columns, values)
    ])).alias("r")
    return spark.range(1).select(rows).select("r.*").orderBy("importance", "feature")


def forest_of(model: PipelineModel) -> RandomForestClassificationModel:
    return next(s for s in model.stages if isinstance(s, RandomForestClassificationModel))


def contributions(columns: list[str], importances: list[float]) -> Column:
    """Scaled value times importance, as shares of the row's sum; equal weights if the sum is not positive.

    The sum goes along as an array: inside the function of an element it would be taken anew for each element.
    """
    values = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    weights = F.array(*[F.lit(float(w)) for w in importances])
    parts = F.zip_with(values, weights, lambda v, w: v * w)
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    even = F.array_repeat(F.lit(UNTRAINED_IMPORTANCE), len(columns))
    shares = F.zip_with(parts, F.array_repeat(total, len(columns)), lambda x, whole: x / whole)
    return F.when(total > 0, shares).otherwise(even)


def score(
    features: DataFrame,
    scaler: MinMax,
    hazard: PipelineModel,
    event: tuple[MinMax, PipelineModel | Bag, float] | None = None,
    fused: DataFrame | None = None,
    columns: list[str] = FEATURES,
    fusion: tuple[PipelineModel, DataFrame] | None = None,
) -> DataFrame:
    """Hazard and event probability, alert, tier and contributions for whole panels.

    ``fused`` may hold (City_ID, Date, fused_prob), or ``fusion`` the fusion model with the rows' ``temp_pred`` by
    (City_ID, Date); without either, and for rows without a prediction, the forest alone decides.
    """
    filled = features.fillna(0, subset=columns)
    rows = with_probability(scaler.transform(filled, SCALED), hazard, "hazard_prob")
    shares = contributions(scaled_names(columns), list(forest_of(hazard).featureImportances.toArray()))
    rows = rows.withColumn("contributions", shares).drop(*scaled_names(columns))
    if event is None:
        rows = rows.withColumns({
            "event_prob": F.lit(None).cast("double"), "event_alert": F.lit(0), "event_threshold": F.lit(0.5),
        })
    else:
        event_scaler, event_model, threshold = event
        rows = with_probability(event_scaler.transform(rows, SCALED), event_model, "event_prob")
        rows = rows.drop(*scaled_names(columns)).withColumns({
            "event_alert": flag(F.col("event_prob") >= threshold), "event_threshold": F.lit(float(threshold)),
        })
    if fused is not None:
        keys = [c for c in fused.columns if c != "fused_prob"]
        rows = rows.join(fused, keys, "left")
    elif fusion is not None:
        model, temperatures = fusion
        keys = [c for c in temperatures.columns if c != "temp_pred"]
        rows = with_probability(rows.join(temperatures, keys, "left"), model, "fused_prob")
        rows = rows.withColumn("fused_prob", F.when(F.col("temp_pred").isNotNull(), F.col("fused_prob"))).drop("temp_pred")
    final = F.coalesce("fused_prob", "hazard_prob") if fused is not None or fusion is not None else F.col("hazard_prob")
    pct = clamp_pct(final * 100.0)
    return rows.withColumns({"probability_pct": pct, "tier": risk_tier(pct)})


def chip_tabular_fusion(df: DataFrame, inputs=("chip_prob", "event_prob"), label: str = "label") -> PipelineModel:
    """Logistic fusion of chip and station-day probabilities, fit on the training years, down to the optimum."""
    assemble = assembler(list(inputs))
    rows = assemble.transform(df.withColumn("label", F.col(label).cast("double"))).select("features", "label")
    return PipelineModel([assemble, LogisticRegression(regParam=FUSION_RIDGE, maxIter=200, tol=1e-12).fit(rows)])
