"""Model jobs. SQL has no models, so the queries return what it can state of their scores: the rows, bounds and rules."""

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyledger.functions.hazards import clamp_pct, risk_tier
from skyledger.operators import learners as L
from skyledger.operators.bootstrap import bootstrap_weights, poisson_limits
from skyledger.operators.cleaning import fill_defaults
from skyledger.operators.lineage import scratch_path, settle
from skyledger.operators.metrics import ranking_metrics, regression_metrics
from skyledger.operators.nodes import node_importances, node_table, with_node_scores
from skyledger.operators.splits import chronological_split, minmax_fit
from skyledger.operators.timing import event_rates, label_chips
from skyledger.plans.chips import fuse_chips
from skyledger.plans.features import feature_panel
from skyledger.plans.scoring import score_panel, score_today
from skyledger.plans.training import Trained, hazard_scores, temperature_scores, train
from skyledger.registry.entries import query
from skyledger.registry.features import assembled
from skyledger.registry.panel_sql import SOURCES, upto
from skyledger.registry.proxies import USER_ID, over
from skyledger.schema import DAY, FEATURES, SEQUENCE, STATION
from skyledger.sources.writers import load_models, save_models, write_run_report

EVENT_CUTS = ("2001-01-01", "2001-06-01")
_memo: dict[tuple, object] = {}


def once(t, name, make):
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


def features(t):
    return once(t, "features", lambda: settle(feature_panel(assembled(t)), "features"))


def trained(t) -> Trained:
    return once(t, "trained", lambda: train(features(t), event_cuts=EVENT_CUTS, written=True))


def on_panel(statement: str) -> str:
    """The statement over ``rows``, the feature rows with their number within the station."""
    return over(SOURCES, statement, **upto("target"), rows="""
        SELECT station, d, risk, ROW_NUMBER() OVER (PARTITION BY station ORDER BY d) AS place FROM target WHERE risk IS NOT NULL""")


PANEL_ROWS = f"""
    SELECT station, d, event_label_available, event_label, risk, {", ".join(
        (f"GREATEST({c}, 0)" if c == "PRESSURE_DROP_3D" else f"COALESCE({c}, 0)") + f"::DOUBLE AS {c}" for c in FEATURES)}
    FROM target WHERE risk IS NOT NULL"""

# A fixed forest: five complete trees of four levels, every value a rule of tree and node.
TREES, NODES, INNER = 5, 31, 15
RULES = {
    "feature": f"(tree * 7 + node * 5) % {len(FEATURES)}", "threshold": "((tree * 3 + node * 7) % 13 + 0.37D) / 14",
    "left": "node * 2 + 1", "right": "node * 2 + 2", "gain": "((node + tree) % 5 + 1) / 10D",
}
CHANCE, WEIGHT = "((tree * 11 + node * 17) % 23 + 0.37D) / 23D", "(31 - node) * 1D"


def fixed_forest(t):
    """Written and read again, as a saved forest is."""
    nodes = t.spark.range(TREES * NODES).select(
        F.expr(f"int(id div {NODES})").alias("tree"), F.expr(f"int(id % {NODES})").alias("node"))
    inner = F.col("node") < INNER
    return once(t, "nodes", lambda: settle(nodes.select(
        "tree", "node", *[F.when(inner, F.expr(rule)).alias(name) for name, rule in RULES.items()],
        F.expr(CHANCE).alias("probability"), F.expr(WEIGHT).alias("weight")), "nodes"))


def in_duck(rule: str) -> str:
    return re.sub(r"([0-9.]+)D\b", r"\1::DOUBLE", rule).replace("/ 14", "/ 14::DOUBLE")


FOREST_VIEWS = {
    "panel": PANEL_ROWS,
    "numbered": f"SELECT id // {NODES} AS tree, id % {NODES} AS node FROM range({TREES * NODES}) AS ids(id)",
    "nodes": "SELECT tree, node, " + ", ".join(
        f"CASE WHEN node < {INNER} THEN {in_duck(rule)} END AS {name}" for name, rule in RULES.items()
    ) + f", {in_duck(CHANCE)} AS probability, {in_duck(WEIGHT)} AS weight FROM numbered",
    "gains": "SELECT tree, feature, SUM(gain * weight) AS gain FROM nodes WHERE feature IS NOT NULL GROUP BY 1, 2",
    "shares": """SELECT feature, SUM(gain / total) / ANY_VALUE(trees) AS share FROM gains
                 JOIN (SELECT tree, SUM(gain) AS total FROM gains GROUP BY 1) USING (tree),
                      (SELECT COUNT(DISTINCT tree) AS trees FROM gains) GROUP BY feature""",
    "weighed": "SELECT f.place, f.name, COALESCE(share, 0) AS importance FROM ("
               + " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS name" for i, c in enumerate(FEATURES))
               + ") f LEFT JOIN shares s ON s.feature = f.place",
}
SCALED_ROW = ", ".join(
    f"({c} - MIN({c}) OVER ()) / CASE WHEN MAX({c}) OVER () = MIN({c}) OVER () THEN 1 ELSE MAX({c}) OVER () - MIN({c}) OVER () END"
    for c in FEATURES)


@query(
    "forest_importances", "feature:s importance:f",
    over("obs", "SELECT name AS feature, importance FROM weighed", **{k: v for k, v in FOREST_VIEWS.items() if k != "panel"}),
)
def _node_importances(t):
    return node_importances(fixed_forest(t), FEATURES)


@query(
    "forest_scores", "station:s d:s hazard_prob:f probability_pct:f tier:s contribution_rain:f contribution_heat:f largest:f total:f",
    over(
        SOURCES,
        """SELECT station, d, p AS hazard_prob, 100 * p AS probability_pct,
                  CASE WHEN 100 * p < 30 THEN 'Low Risk' WHEN 100 * p < 60 THEN 'Moderate Alert' WHEN 100 * p < 85 THEN 'Severe Warning'
                       ELSE 'Extreme Danger' END AS tier,
                  shares[(SELECT place + 1 FROM weighed WHERE name = 'PRCP_30D')] AS contribution_rain,
                  shares[(SELECT place + 1 FROM weighed WHERE name = 'HEAT_INDEX')] AS contribution_heat,
                  list_max(shares) AS largest, list_sum(shares) AS total
           FROM (SELECT station, d, p, CASE WHEN list_sum(parts) > 0 THEN list_transform(parts, lambda v: v / list_sum(parts))
                        ELSE list_transform(parts, lambda v: 0.1::DOUBLE) END AS shares
                 FROM (SELECT station, d, p, list_transform(list_zip(x, w), lambda z: z[1] * z[2]) AS parts
                       FROM reached JOIN scaled USING (station, d), (SELECT LIST(importance ORDER BY place) AS w FROM weighed)))""",
        **upto("target"), **FOREST_VIEWS, scaled=f"SELECT station, d, [{SCALED_ROW}] AS x FROM panel",
        level0="SELECT station, d, x, tree, 0 AS node FROM scaled, (SELECT DISTINCT tree FROM nodes)",
        **{f"level{k + 1}": f"""SELECT station, d, x, l.tree, CASE WHEN x[feature + 1] <= threshold THEN "left" ELSE "right" END AS node
                                FROM level{k} l JOIN nodes n ON n.tree = l.tree AND n.node = l.node""" for k in range(4)},
        reached="""SELECT station, d, AVG(probability) AS p FROM level4 l JOIN nodes n ON n.tree = l.tree AND n.node = l.node GROUP BY 1, 2""",
    ),
)
def _node_scores(t):
    """Probability, tier and contributions of every panel row from a forest that is a table."""
    rows, nodes = features(t), fixed_forest(t)
    scaled = minmax_fit(rows, FEATURES).transform(rows.select(STATION, DAY, *FEATURES), L.SCALED)
    weights = {r["feature"]: r["importance"] for r in node_importances(nodes, FEATURES).collect()}
    shares = L.contributions(L.scaled_names(FEATURES), [weights[c] for c in FEATURES])
    scored = with_node_scores(scaled, nodes, L.scaled_names(FEATURES), [STATION, DAY], "hazard_prob").join(
        scaled.select(STATION, DAY, shares.alias("shares")), [STATION, DAY])
    pct = clamp_pct(F.col("hazard_prob") * 100.0)
    return scored.withColumns({
        "probability_pct": pct, "tier": risk_tier(pct), "contribution_rain": F.get("shares", F.lit(FEATURES.index("PRCP_30D"))),
        "contribution_heat": F.get("shares", F.lit(FEATURES.index("HEAT_INDEX"))), "largest": F.array_max("shares"),
        "total": F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)})


@query(
    "bootstrap_weights", "station:s d:s bootstrap:i copies:i weight:f",
    over(
        SOURCES,
        "SELECT station, d, bootstrap, copies, copies * n / (classes * of_class) AS weight FROM counted",
        **upto("target"), panel=PANEL_ROWS,
        shares="""SELECT station, d, event_label AS y, bootstrap, ('0x' || SUBSTR(MD5(station || '|' || strftime(d, '%Y-%m-%d') || '|'
                         || bootstrap || '|143'), 1, 5))::INTEGER / 1048576::DOUBLE AS share
                  FROM panel, (SELECT UNNEST(range(4)) AS bootstrap) WHERE event_label IS NOT NULL""",
        drawn="SELECT station, d, y, bootstrap, " + " + ".join(
            f"CASE WHEN share >= {limit!r}::DOUBLE THEN 1 ELSE 0 END" for limit in poisson_limits()) + " AS copies FROM shares",
        classes="SELECT bootstrap, y, SUM(copies)::DOUBLE AS of_class FROM drawn WHERE copies > 0 GROUP BY 1, 2",
        totals="SELECT bootstrap, SUM(of_class) AS n, COUNT(*) AS classes FROM classes GROUP BY 1",
        counted="SELECT * FROM drawn JOIN classes USING (bootstrap, y) JOIN totals USING (bootstrap) WHERE copies > 0",
    ),
)
def _bootstraps(t):
    """Draws and balanced weights of labelled rows, as the event forest takes them."""
    return bootstrap_weights(features(t).select(STATION, DAY, "EVENT_LABEL"), "EVENT_LABEL", [STATION, DAY], 4, 143)


def within(name: str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.coalesce(F.col(name).between(low, high), F.lit(False)).cast("int")


@query("hazard_forest", "station:s d:s risk:f in_range:i", on_panel("SELECT station, d, risk, 1 AS in_range FROM rows"))
def _hazard(t):
    return hazard_scores(features(t), trained(t)).withColumn("in_range", within("hazard_prob"))


@query("event_forest", "station:s d:s in_range:i", on_panel("SELECT station, d, 1 AS in_range FROM rows"))
def _event(t):
    model = trained(t)
    scaled = model.event_scaler.transform(features(t), L.SCALED)
    return L.with_probability(scaled, model.event, "event_prob").withColumn("in_range", within("event_prob"))


@query("next_day_temperature", "station:s d:s in_range:i", on_panel("SELECT station, d, 1 AS in_range FROM rows WHERE place > 30"))
def _temperature(t):
    """Scaled temperatures: the fit stays near the unit range."""
    scored = temperature_scores(features(t).fillna(0, subset=SEQUENCE).withColumn("split", F.lit("all")), trained(t))
    return scored.withColumn("in_range", within("temp_pred", -1.0, 2.0))


@query("fusion_classifier", "station:s d:s in_range:i", on_panel("SELECT station, d, 1 AS in_range FROM rows WHERE place > 30"))
def _fusion(t):
    model = trained(t)
    temps = temperature_scores(features(t).fillna(0, subset=SEQUENCE).withColumn("split", F.lit("all")), model)
    both = temps.join(hazard_scores(features(t), model).select(STATION, DAY, "hazard_prob"), [STATION, DAY])
    return L.with_probability(both, model.fusion, "fused_prob").withColumn("in_range", within("fused_prob"))


@query(
    "feature_importances", "feature:s in_range:i total:f",
    f"SELECT UNNEST([{', '.join(repr(c) for c in FEATURES)}]) AS feature, 1 AS in_range, 1 AS total",
)
def _importances(t):
    """One row per feature; together they are 1."""
    found = L.feature_importances(t.spark, trained(t).hazard)
    return found.withColumns({"in_range": within("importance"), "total": F.sum("importance").over(Window.partitionBy())})


@query(
    "score_panel", "station:s d:s in_range:i alert_follows:i source_follows:i contribution_sum:f",
    on_panel("SELECT station, d, 1 AS in_range, 1 AS alert_follows, 1 AS source_follows, 1 AS contribution_sum FROM rows"),
)
def _score(t):
    """Alerts follow the threshold; the percentage is the fused probability, or the forest's without one."""
    final = F.coalesce("fused_prob", "hazard_prob")
    return score_panel(features(t), trained(t)).withColumns({
        "in_range": within("probability_pct", 0.0, 100.0) * within("hazard_prob") * within("event_prob"),
        "alert_follows": (F.col("event_alert") == (F.col("event_prob") >= F.col("event_threshold")).cast("int")).cast("int"),
        "source_follows": (F.abs(F.col("probability_pct") - F.least(F.greatest(final * 100, F.lit(0.0)), F.lit(100.0))) < 1e-9).cast("int"),
        "contribution_sum": F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x),
    })


@query(
    "score_today", "station:s in_range:i alert_known:i",
    over("obs", "SELECT DISTINCT station, 1 AS in_range, 1 AS alert_known FROM obs"),
)
def _today(t):
    history = fill_defaults(assembled(t))
    current = t.obs().groupBy(STATION).agg(
        F.max("TMAX").alias("TMAX"), F.min("TMIN").alias("TMIN"), F.lit(10.0).alias("D"), F.lit(15.0).alias("W"),
        F.coalesce(F.max("PRCP"), F.lit(0.0)).alias("PRCP"),
    )
    return score_today(history, current, trained(t)).withColumns({
        "in_range": within("probability_pct", 0.0, 100.0), "alert_known": F.col("event_alert").isin(0, 1).cast("int")})


@query("training_metrics", "metric:s value:f")
def _metrics(t):
    model = trained(t)
    folder = once(t, "report", lambda: scratch_path(t.spark, "report"))
    write_run_report(t.spark, model.metrics, model.manifest, folder)
    values = t.spark.read.text(f"{folder}/metrics").select(F.from_json("value", "map<string,string>").alias("m"))
    return values.select(F.explode("m").alias("metric", "value")).withColumn("value", F.col("value").try_cast("double"))


MANIFEST_FACTS = {
    "forecast_horizon_days": 1, "sequence_length_days": 30, "minimum_recommended_history_years": 10, "preferred_history_years": 20}
MANIFEST_VIEWS = {
    "panel": "SELECT station, d, event_label_available FROM target WHERE risk IS NOT NULL",
    "days": "SELECT d, COUNT(*) AS n FROM panel GROUP BY 1",
    "running": "SELECT d, SUM(n) OVER (ORDER BY d) - n AS below, SUM(n) OVER () AS total FROM days",
    "cuts": """SELECT d, CASE WHEN below < FLOOR(total * 70 / 100) THEN 'train' WHEN below < FLOOR(total * 85 / 100) THEN 'validation'
                              ELSE 'test' END AS split FROM running""",
    "parts": """SELECT split, COUNT(*) AS n, strftime(MIN(d), '%Y-%m-%d') AS a, strftime(MAX(d), '%Y-%m-%d') AS b
                FROM panel JOIN cuts USING (d) GROUP BY 1""",
}


@query(
    "training_manifest", "fact:s value:s",
    over(
        SOURCES,
        " UNION ALL ".join([
            *[f"SELECT '{k}' AS fact, '{v}' AS value" for k, v in MANIFEST_FACTS.items()],
            "SELECT split || '_rows', n::VARCHAR FROM parts", "SELECT split || '_start', a FROM parts", "SELECT split || '_end', b FROM parts",
            "SELECT 'station_count', COUNT(DISTINCT station)::VARCHAR FROM panel",
            "SELECT 'event_labeled_rows', SUM(event_label_available)::BIGINT::VARCHAR FROM panel",
            f"SELECT 'rf_features', '{len(FEATURES)}'",
        ]), **upto("target"), **MANIFEST_VIEWS),
)
def _run_manifest(t):
    """The facts of the written manifest, read again; features as their number, notes left out."""
    folder = once(t, "manifest", lambda: scratch_path(t.spark, "manifest"))
    write_run_report(t.spark, {}, trained(t).manifest, folder)
    text = t.spark.read.text(f"{folder}/training_manifest")
    facts = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("fact", "value"))
    names = F.size(F.from_json("value", "array<string>")).cast("string")
    return facts.filter(~F.col("fact").isin("target", "operational_limit")).withColumn(
        "value", F.when(F.col("fact") == "rf_features", names).otherwise(F.col("value")))


def against_constant(model: str, rows: DataFrame, equal: Column) -> DataFrame:
    """Whether the ranking of ``score`` over ``y`` is clearly better than that of a constant, which has 0.5."""
    return ranking_metrics(rows).select(
        F.lit(model).alias("model"), F.col("rows"), (F.col("roc_auc") > 0.6).cast("int").alias("beats_constant"), equal.alias("equals_nodes"))


@query(
    "model_checks", "model:s rows:n beats_constant:i equals_nodes:i",
    over(
        SOURCES,
        """SELECT 'hazard' AS model, COUNT(*) AS rows, 1 AS beats_constant, 1 AS equals_nodes FROM ranks
           UNION ALL SELECT 'event', COUNT(*), 1, NULL FROM ranks WHERE event_label_available <> 0
           UNION ALL SELECT 'temperature', COUNT(*), 1, NULL FROM ranks WHERE split = 'train' AND place > 30""",
        **upto("target"), **MANIFEST_VIEWS, ranks="""SELECT event_label_available, split, ROW_NUMBER() OVER (PARTITION BY station, split ORDER BY d)
                                                     AS place FROM panel JOIN cuts USING (d)"""),
)
def _checks(t):
    """What a model that learned nothing would fail: over the panel forests rank better than a constant, and the hazard forest
    scores as its node table does; on the rows it was fitted on the regression errs less than their mean. The panel's
    temperatures are noise, so nothing errs less on later rows."""
    model, panel = trained(t), features(t)
    keys, names = [STATION, DAY], L.scaled_names(FEATURES)
    scaled = model.hazard_scaler.transform(panel, L.SCALED)
    nodes = settle(node_table(t.spark, L.forest_of(model.hazard)), "nodes")
    both = L.with_probability(scaled, model.hazard, "score").select(*keys, F.col("RISK").alias("y"), "score").join(
        with_node_scores(scaled, nodes, names, keys, "again"), keys)
    both = settle(both, "both")
    differing = both.agg(F.max(F.abs(F.col("score") - F.col("again")))).scalar()
    covered = model.event_scaler.transform(panel, L.SCALED).filter(F.coalesce("EVENT_LABEL_AVAILABLE", F.lit(0)) != 0)
    events = L.with_probability(covered, model.event, "score").select(
        F.coalesce(F.col("EVENT_LABEL").cast("int"), F.lit(0)).alias("y"), "score")
    fit = regression_metrics(temperature_scores(chronological_split(panel).fillna(0, subset=SEQUENCE).filter("split = 'train'"), model), "target", "temp_pred")
    temperature = fit.select(
        F.lit("temperature").alias("model"), F.col("rows"), (F.col("r2") > 0).cast("int").alias("beats_constant"),
        F.lit(None).cast("int").alias("equals_nodes"))
    return against_constant("hazard", both, (differing < 1e-9).cast("int")).unionByName(
        against_constant("event", events, F.lit(None).cast("int"))).unionByName(temperature)


@query("reload_models", "rows:n differing:n", on_panel("SELECT COUNT(*) AS rows, 0 AS differing FROM rows"))
def _reload(t):
    model = trained(t)
    folder = once(t, "saved", lambda: scratch_path(t.spark, "models"))
    save_models(t.spark, folder, model.models(), model.scalers(), model.event_threshold)
    again = Trained.restored(load_models(t.spark, folder))
    first = hazard_scores(features(t), model).select(STATION, DAY, F.col("hazard_prob").alias("a"))
    second = hazard_scores(features(t), again).select(STATION, DAY, F.col("hazard_prob").alias("b"))
    return first.join(second, [STATION, DAY]).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-12).alias("differing")
    )


CHIP_CUTS = ("2024-01-19", "2024-01-25")
NEWTON_STEPS = 10


def newton(k: int) -> str:
    """Step ``k`` of the penalised logistic fit over standardised inputs: three unknowns, solved by cofactors."""
    ridge = f"{L.FUSION_RIDGE!r}::DOUBLE"
    sums = ", ".join([
        "ANY_VALUE(b0) AS b0, ANY_VALUE(b1) AS b1, ANY_VALUE(b2) AS b2, AVG(p - label) AS g0",
        f"AVG((p - label) * x1) + {ridge} * ANY_VALUE(b1) AS g1, AVG((p - label) * x2) + {ridge} * ANY_VALUE(b2) AS g2",
        "AVG(p * (1 - p)) AS a, AVG(p * (1 - p) * x1) AS b, AVG(p * (1 - p) * x2) AS c, AVG(p * (1 - p) * x1 * x2) AS e",
        f"AVG(p * (1 - p) * x1 * x1) + {ridge} AS dd, AVG(p * (1 - p) * x2 * x2) + {ridge} AS f",
    ])
    det = "(a * (dd * f - e * e) - b * (b * f - c * e) + c * (b * e - c * dd))"
    return f"""
        SELECT b0 - ((dd * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * dd) * g2) / {det} AS b0,
               b1 - ((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2) / {det} AS b1,
               b2 - ((b * e - c * dd) * g0 + (b * c - a * e) * g1 + (a * dd - b * b) * g2) / {det} AS b2
        FROM (SELECT {sums} FROM (SELECT *, 1 / (1 + EXP(-(b0 + b1 * x1 + b2 * x2))) AS p FROM fitted, newton{k - 1}) y) z"""


CHIP_VIEWS = {
    "shots": f"""SELECT event_id AS chip_id, {USER_ID} AS station, ts, value / (value + 40) AS chip_prob
                 FROM events WHERE event_type <> 'error'""",
    "near": """SELECT c.chip_id, c.station, c.ts, c.chip_prob, EPOCH_US(c.ts) - EPOCH_US(s.ts) AS us FROM shots c
               LEFT JOIN fx_storms s ON s.station = c.station AND s.ts BETWEEN c.ts - INTERVAL 12 HOUR AND c.ts + INTERVAL 12 HOUR""",
    "marked": """SELECT chip_id, station, ts, CAST(ts AS DATE) AS d, chip_prob,
                        CASE WHEN BOOL_OR(COALESCE(ABS(us) <= 6 * 3600000000, FALSE)) THEN 1 WHEN COUNT(us) > 0 THEN -1 ELSE 0 END AS label
                 FROM near GROUP BY ALL""",
    "struck": "SELECT DISTINCT station, d FROM storms",
    "asked": "SELECT DISTINCT station, d FROM marked",
    "rates": """SELECT a.station, a.d, (COUNT(h.d) + 1)::DOUBLE / (DATE_DIFF('day', ANY_VALUE(first), a.d) + 2) AS event_prob
                FROM asked a LEFT JOIN struck h ON h.station = a.station AND h.d < a.d,
                     (SELECT LEAST((SELECT MIN(d) FROM asked), (SELECT MIN(d) FROM struck)) AS first) GROUP BY a.station, a.d""",
    "evaluated": f"""SELECT chip_id, station, d, chip_prob, event_prob, label, CASE WHEN d < DATE '{CHIP_CUTS[0]}' THEN 'train'
                            WHEN d < DATE '{CHIP_CUTS[1]}' THEN 'validation' ELSE 'test' END AS split
                     FROM marked JOIN rates USING (station, d) WHERE label >= 0""",
    "spreads": "SELECT STDDEV_SAMP(chip_prob) AS s1, STDDEV_SAMP(event_prob) AS s2 FROM evaluated WHERE split = 'train'",
    "fitted": "SELECT chip_prob / s1 AS x1, event_prob / s2 AS x2, label FROM evaluated, spreads WHERE split = 'train'",
    "newton0": "SELECT 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2",
    **{f"newton{k}": newton(k) for k in range(1, NEWTON_STEPS + 1)},
    "fused": f"""SELECT chip_id, split, label, 1 / (1 + EXP(-(b0 + b1 * chip_prob / s1 + b2 * event_prob / s2))) AS score
                 FROM evaluated, spreads, newton{NEWTON_STEPS}""",
    "tried": """SELECT pct, 2 * SUM(CASE WHEN score >= pct / 100::DOUBLE THEN label ELSE 0 END)
                       / (COUNT(CASE WHEN score >= pct / 100::DOUBLE THEN 1 END) + SUM(label)) AS f1
                FROM fused, (SELECT UNNEST(range(5, 96)) AS pct) WHERE split = 'validation' GROUP BY pct""",
    "best": "SELECT pct / 100::DOUBLE AS threshold, f1 AS validation_f1 FROM tried ORDER BY f1 DESC, pct LIMIT 1",
    "called": "SELECT chip_id, split, label, score, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS called FROM fused, best",
    "levels": "SELECT score, SUM(label) AS pos, COUNT(*) AS n FROM fused WHERE split = 'test' GROUP BY 1",
    "curve": """SELECT pos, n, SUM(n - pos) OVER (ORDER BY score) - (n - pos) AS lower, SUM(pos) OVER (ORDER BY score DESC) AS tp,
                       SUM(n) OVER (ORDER BY score DESC) AS reached, SUM(pos) OVER () AS p, SUM(n) OVER () AS t FROM levels""",
    "ranked": """SELECT SUM(pos * (lower + 0.5::DOUBLE * (n - pos))) / (MAX(p) * (MAX(t) - MAX(p))) AS test_auc,
                        SUM(pos * tp / reached) / MAX(p) AS test_average_precision FROM curve""",
    "cells": """SELECT AVG(CASE WHEN label = called THEN 1 ELSE 0 END) AS test_accuracy,
                       COALESCE(2 * SUM(label * called) / NULLIF(SUM(label) + SUM(called), 0), 0) AS test_f1 FROM called WHERE split = 'test'""",
}


def fused_chips(t):
    """Every report but the storms is a chip with its value as the image model's score; storms label them and give the station's rate."""
    reports = t.read("events").filter("event_type <> 'error'")
    images = reports.select(
        F.col("event_id").alias("chip_id"), t.station_id(F.col("user_id")).alias(STATION), "ts",
        (F.col("value") / (F.col("value") + 40)).alias("chip_prob"))
    rates = event_rates(images.select(STATION, F.to_date("ts").alias(DAY)), t.storms())
    return once(t, "chips", lambda: fuse_chips(label_chips(images, t.storms()), rates, *CHIP_CUTS))


@query(
    "chip_tabular_fusion",
    "split_strategy:s train_rows:n validation_rows:n test_rows:n test_positives:n threshold:f validation_f1:f"
    " test_accuracy:f test_f1:f test_auc:f test_average_precision:f",
    over("storms", """SELECT 'dates' AS split_strategy, threshold, validation_f1, test_accuracy, test_f1, test_auc, test_average_precision,
                             (SELECT COUNT(*) FROM fused WHERE split = 'train') AS train_rows,
                             (SELECT COUNT(*) FROM fused WHERE split = 'validation') AS validation_rows,
                             (SELECT COUNT(*) FROM fused WHERE split = 'test') AS test_rows,
                             (SELECT SUM(label) FROM fused WHERE split = 'test') AS test_positives FROM best, cells, ranked""", **CHIP_VIEWS),
)
def _chips(t):
    return t.spark.range(1).select(*[F.lit(v).alias(k) for k, v in fused_chips(t).metrics.items()])


@query(
    "chip_tabular_scores", "chip_id:n split:s label:i called:i score_thousandths:n",
    over("storms", "SELECT chip_id, split, label, called, FLOOR(score * 1000 + 1e-5) AS score_thousandths FROM called", **CHIP_VIEWS),
)
def _chip_scores(t):
    """Every evaluated chip; SQL fits the same optimum by Newton steps."""
    return fused_chips(t).scored.withColumn("score_thousandths", F.floor(F.col("score") * 1000 + 1e-5))
