"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Each text gives a vector of transformed statistics. Per group of language and source the estimates of location and
scatter come from the three quarters of its documents whose covariance determinant is least: two deterministic
starts (median and deviation; correlations of squashed values) are improved by concentration steps, each of which
keeps the nearest rows under the last estimate and estimates anew; the start with the lesser determinant wins and is
re-weighted once. A document is rejected if its squared Mahalanobis distance is beyond ``cutoff``.

Only DataFrame functions are used. Texts are read once and their statistics written; all further passes read the
numbers. Moments and quantiles are partial aggregates, and estimates are joined on a salted key, so a source with a
third of all documents is as even as the others. A group under ``least`` documents takes its language's estimates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.operators.lineage import settle

BLANKS = r"[\x20\x09-\x0D]+"
#: The transformed statistics with the least scale that a group's spread counts as. In a group without spread a value
#: alone is beyond a squared distance c from scale * sqrt(c * ridge) on: at 100 and 0.1 words 1.6 times as long as
#: usual, 4.4 % symbols, 57 % repeated lines, 41 % words in repeated windows (over 50 % fail the base rule).
VECTOR = {"word_length": 0.15, "symbols": 0.2, "lines": 0.18, "repeats": 0.13}
P = len(VECTOR)
#: Quantiles of the chi-squared distribution with four degrees of freedom: 0.5 and 0.975.
CHI_HALF, CHI_975 = 3.3567, 11.1433
SALTS = 32
STARTS = 2


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text (null: empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, BLANKS), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("__words")
    triples = F.when(n > 2, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*(F.get("__words", i + k) for k in range(3)))))
    ordered = F.when(
        F.size(F.array_distinct("__triples")) < F.size("__triples"),
        F.sort_array(F.transform("__triples", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def twin(x: Column, j: Column) -> Column:
        near = [F.get("__ordered", j + k)["h"].eqNullSafe(x["h"]) for k in (-1, 1)]
        return near[0] | near[1]

    places = F.transform(F.filter("__ordered", twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return (
        docs.withColumns({
            "__words": words, "__lines": lines,
            "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        })
        .withColumns({
            "n_words": n.cast("long"), "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__triples": triples,
        })
        .withColumn("__ordered", ordered)
        .withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(F.flatten(places))), F.lit(0)).cast("long"))
        .drop("__words", "__lines", "__triples", "__ordered")
    )


def vector() -> dict[str, Column]:
    """The transformed statistics: logarithms bring tails in; shares of repeats stay plain, so that a short text with one
    repeated line is near and one with many is far."""
    words = F.greatest("n_words", F.lit(1))
    return {
        "word_length": F.log(F.greatest(F.col("word_chars") / words, F.lit(1.0))),
        "symbols": F.log1p(20 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
    }


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _factor(moments: DataFrame, keys: list[str], ridge: float) -> DataFrame:
    """Means and the lower Cholesky factor of the ridged covariance, from sums of products.

    With columns n, s0.., q00..: keys, m0.., l00.. and the log determinant.
    """
    out = moments.select(*keys, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[
        ((F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("n") * F.col("n"))) * (1 - ridge)
         + (ridge if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _pairs()])
    for j in range(P):
        inner = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner, F.lit(1e-9))))
        out = out.withColumns({
            f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)))
            / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    logdet = sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))
    return out.select(*keys, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in _pairs()], logdet.alias("logdet"))


def _moments(rows: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"{value}{i}").alias(f"s{i}") for i in range(P)],
        *[F.sum(F.col(f"{value}{i}") * F.col(f"{value}{j}")).alias(f"q{i}{j}") for i, j in _pairs()])


def _salted(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join a table of a row per group to rows that may mostly be of one group."""
    spread = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, [*keys, "salt"])


def _distance() -> Column:
    """Squared Mahalanobis distance of z0.. from m0.. by forward substitution."""
    out, y = F.lit(0.0), []
    for i in range(P):
        rest = sum((F.col(f"l{i}{k}") * y[k] for k in range(i)), F.lit(0.0))
        y.append((F.col(f"z{i}") - F.col(f"m{i}") - rest) / F.col(f"l{i}{i}"))
        out = out + y[i] * y[i]
    return out


def covariance_estimates(rows: DataFrame, steps: int, share: float, ridge: float) -> DataFrame:
    """One row per group with m0.., l00..; ``rows`` has group, salt and standardised z0..; each step is written."""
    keys = ["group", "start"]
    squashed = rows.select("group", *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(P)])
    first = _moments(rows, ["group"]).select(
        "group", F.lit(0).alias("start"), *[F.lit(0.0).alias(f"m{i}") for i in range(P)],
        *[F.lit(float(i == j)).alias(f"l{i}{j}") for i, j in _pairs()], F.lit(0.0).alias("logdet"))
    second = _factor(_moments(squashed, ["group"], "t"), ["group"], ridge).withColumn("start", F.lit(1))
    now = settle(first.unionByName(second.select(first.columns)), "start")
    many = rows.withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    for _ in range(steps):
        far = _salted(many, now, keys).withColumn("far", _distance())
        limit = far.groupBy(*keys).agg(F.percentile_approx("far", share, 10_000).alias("limit"))
        now = settle(_factor(_moments(_salted(far, limit, keys).filter("far <= limit"), keys), keys, ridge), "step")
    best = now.groupBy("group").agg(F.min(F.struct("logdet", "start")).alias("best"))
    chosen = settle(now.join(best.select("group", F.col("best.start").alias("start")), keys).drop("start"), "best")
    return _reweighted(rows, chosen, ridge)


def _reweighted(rows: DataFrame, now: DataFrame, ridge: float) -> DataFrame:
    """Scale so that the median distance is the normal one, estimate from the inner rows, scale again."""
    for last in (False, True):
        far = _salted(rows, now, ["group"]).withColumn("far", _distance())
        middle = far.groupBy("group").agg(F.greatest(
            F.percentile_approx("far", 0.5, 10_000) / CHI_HALF, F.lit(1.0)).alias("scale"))
        if last:
            return now.join(middle, "group")
        inner = _salted(far, middle, ["group"]).filter(F.col("far") <= F.col("scale") * CHI_975)
        now = settle(_factor(_moments(inner, ["group"]), ["group"], ridge), "weighted")


def judge(
    docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source",
    cutoff: float = 100.0, least: int = 50, steps: int = 4, share: float = 0.75, ridge: float = 0.1,
) -> DataFrame:
    """One row per document: id, the counts of ``statistics``, ``base_failed``, ``distance`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated windows of three. ``distance`` is null
    for such documents, which no estimate uses. Null language or source is a value of its own; null or empty text
    has no words. Repeated rows count each for itself; ties at the limit of a step are all in. An empty table gives
    no rows. Other columns are not read. Quantiles inside the steps are approximate to one part in 10,000.
    """
    group = F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")))
    wide = F.to_json(F.struct(F.col(lang).alias("l")))
    fine = statistics(docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"), group.alias("fine"), wide.alias("wide"),
        F.pmod(F.xxhash64(key, text), F.lit(SALTS)).cast("int").alias("salt")), "text").drop("text")
    fine = settle(
        fine.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumns(vector()), "statistics")
    good = fine.filter("NOT base_failed")
    counts = good.groupBy("fine", "wide").count().withColumn(
        "group", F.when(F.col("count") >= least, F.col("fine")).otherwise(F.col("wide"))).select("fine", "group")
    # A small group's language is a group of all documents of the language.
    named = _salted(good, counts, ["fine"])
    fitted = named.select("group", "salt", *VECTOR).union(
        _salted(good, counts.filter("group <> fine").select(F.col("group").alias("wide")).distinct(), ["wide"])
        .select(F.col("wide").alias("group"), "salt", *VECTOR))
    own = settle(fitted.groupBy("group").agg(
        *[F.percentile_approx(c, 0.5, 10_000).alias(f"a{i}") for i, c in enumerate(VECTOR)]), "medians")
    spread = settle(_salted(fitted, own, ["group"]).groupBy("group").agg(*[
        F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(c) - F.col(f"a{i}")), 0.5, 10_000), F.lit(VECTOR[c]))
        .alias(f"b{i}") for i, c in enumerate(VECTOR)]).join(own, "group"), "scales")

    def scaled(rows: DataFrame, *more: str) -> DataFrame:
        return _salted(rows, spread, ["group"]).select(*more, "group", "salt", *[
            ((F.col(c) - F.col(f"a{i}")) / F.col(f"b{i}")).alias(f"z{i}") for i, c in enumerate(VECTOR)])

    estimates = covariance_estimates(settle(scaled(fitted), "scaled"), steps, share, ridge)
    counted = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    judged = _salted(scaled(named, "id", *counted), estimates, ["group"]).select(
        "id", *counted, F.lit(False).alias("base_failed"), (_distance() / F.col("scale")).alias("distance"))
    failed = fine.filter("base_failed").select(
        "id", *counted, F.lit(True).alias("base_failed"), F.lit(None).cast("double").alias("distance"))
    return judged.union(failed).select(
        F.col("id").alias(key), *counted, "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))
