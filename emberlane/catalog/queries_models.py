"""Registered queries: models and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.catalog.registry import query
from emberlane.catalog.snippets import (
    FALSE_ALARM,
    FALSE_ALARM_OR_ZERO,
    FEATURE_NAMES,
    FOCUS_INCIDENTS,
    LABELLED_INCIDENTS,
    SCORED,
    ZIP_FEATURES,
    forest,
    link,
    logistic,
    nearest,
    split,
)
from emberlane.functions.logic import above, false_alarm, false_alarm_or_zero
from emberlane.models import evaluation
from emberlane.models.forest import fit_forest
from emberlane.models.kde_bayes import fit_kernel_bayes
from emberlane.models.knn import fit_knn
from emberlane.models.logistic import fit_logistic
from emberlane.models.odds import class_weight, odds_by_group, odds_overall
from emberlane.models.split import split_exact
from emberlane.operators.aggregates import approval_rate
from emberlane.operators.joins import lookup_join
from emberlane.plans import top_alarm_boxes, zips_in_focus
from emberlane.plans.incidents import clean_incidents
from emberlane.plans.top_alarm_boxes import FACTORS
from emberlane.plans.zip_features import FEATURES, LABEL, zip_features
from emberlane.session import materialise


def features_of(t) -> DataFrame:
    """The zip features, written once: models read them many times."""
    return materialise(zip_features(t.incidents, t.inspections, t.fitness, t.violations), "zip-features")


def _divided(t) -> tuple[DataFrame, DataFrame]:
    divided = split_exact(features_of(t), "ZIPCODE")
    return divided.where("split = 'train'"), divided.where("split = 'validate'")


def _labelled_incidents(t) -> DataFrame:
    """Incidents with time factors and their zip's features, without NULLs."""
    features = features_of(t).select("ZIPCODE", *FEATURES)
    cleaned = clean_incidents(t.incidents).select(
        "STARFIRE_INCIDENT_ID", "ZIPCODE", "false_alarm", *[F.col(f).cast("string").alias(f) for f in FACTORS]
    )
    return materialise(lookup_join(cleaned, features, "ZIPCODE").na.drop("any"), "labelled-incidents")


_SPLIT_SQL = split("(SELECT ordinal FROM fitness)", "ordinal")


@query("ml_split_exact", f"SELECT ordinal, split FROM ({_SPLIT_SQL})")
def ml_split_exact(t):
    return split_exact(t.fitness.select("ordinal"), "ordinal")


_PARTS_SQL = f"""{ZIP_FEATURES}, s AS ({split('zf', 'ZIPCODE')}), train AS (SELECT * FROM s WHERE split = 'train'),
    validate AS (SELECT * FROM s WHERE split = 'validate')"""


_INCIDENT_PARTS_SQL = f"""{ZIP_FEATURES}, {LABELLED_INCIDENTS}, divided AS ({split("labelled", "STARFIRE_INCIDENT_ID")}),
    train AS (SELECT * FROM divided WHERE split = 'train'), validate AS (SELECT * FROM divided WHERE split = 'validate')"""
# The odds of a large estimate have more digits than any fit: those of the rounded estimate are shown.
_TERMS_SQL = "SELECT term, round(estimate, 6) AS estimate, round(exp(round(estimate, 6)), 6) AS odds FROM g_terms"


def _terms(model, t) -> DataFrame:
    rounded = F.round("estimate", 6) + F.lit(0.0)
    return model.coefficients(t.spark).select("term", rounded.alias("estimate"), F.round(F.exp(rounded), 6).alias("odds"))


@query("ml_logit", f"WITH RECURSIVE {_PARTS_SQL}, {logistic('train', LABEL, FEATURE_NAMES)} {_TERMS_SQL}")
def ml_logit(t):
    train, _ = _divided(t)
    return _terms(fit_logistic(train, LABEL, FEATURES), t)


@query(
    "ml_logit_scores",
    f"""WITH RECURSIVE {_PARTS_SQL}, {logistic('train', LABEL, FEATURE_NAMES)}, linked AS (SELECT ZIPCODE, {link(FEATURE_NAMES)} AS link FROM zf, g_fit)
    SELECT ZIPCODE, round(link, 6) AS link, round(1 / (1 + exp(-link)), 6) AS probability FROM linked""",
)
def ml_logit_scores(t):
    """Both scoring modes for every zip: the log-odds and the probability."""
    train, _ = _divided(t)
    scored = fit_logistic(train, LABEL, FEATURES).score(features_of(t))
    return _rounded(scored.select("ZIPCODE", "link", "probability"), "link", "probability")


_WEIGHT_SQL = "CASE WHEN false_alarm = 1 THEN (SELECT count(*) FILTER (WHERE false_alarm = 0) / count(*) FILTER (WHERE false_alarm = 1) FROM {rows}) ELSE 1.0 END"
_LABELLED_WEIGHT = _WEIGHT_SQL.format(rows="labelled")
_INCIDENT_MODEL = logistic("labelled", "false_alarm", FEATURE_NAMES, FACTORS, _LABELLED_WEIGHT)


def _weighted_model(t):
    incidents = _labelled_incidents(t)
    weight = F.when(F.col("false_alarm") == 1, class_weight(incidents, "false_alarm")).otherwise(F.lit(1.0))
    return incidents.withColumn("weight", weight), fit_logistic(incidents, "false_alarm", FEATURES, FACTORS, weight)


@query("ml_logit_weighted", f"WITH RECURSIVE {ZIP_FEATURES}, {LABELLED_INCIDENTS}, {_INCIDENT_MODEL} {_TERMS_SQL}")
def ml_logit_weighted(t):
    return _terms(_weighted_model(t)[1], t)


_FACTOR_TERMS_SQL = " UNION ALL ".join(
    [
        *[f"SELECT '{f}' AS feature, '' AS level, sum(w * {f}) AS total, count(*) AS n FROM weighed" for f in FEATURE_NAMES],
        *[f"SELECT '{f}', {f}, sum(w), count(*) FROM weighed GROUP BY {f}" for f in FACTORS],
    ]
)


@query(
    "ml_logit_balance",
    f"""WITH {ZIP_FEATURES}, {LABELLED_INCIDENTS}, weighed AS (SELECT *, ({_LABELLED_WEIGHT}) * false_alarm AS w FROM labelled),
    sums AS ({_FACTOR_TERMS_SQL}) SELECT feature, level, round(total / n, 6) AS mean FROM sums""",
)
def ml_logit_balance(t):
    """Where the likelihood is largest, the fitted and the observed outcomes agree in every feature's and every level's weighted
    sum. This is the fitted side; its SQL is the observed one and fits nothing."""
    incidents, model = _weighted_model(t)
    scored = materialise(model.score(incidents).withColumn("w", F.col("weight") * F.col("probability")), "scored-incidents")
    numeric = scored.agg(*[F.avg(F.col("w") * F.col(f)).alias(f) for f in FEATURES])
    long = numeric.select(F.explode(F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])).alias("feature", "mean"))
    found = long.select("feature", F.lit("").alias("level"), "mean")
    for factor in FACTORS:
        found = found.unionByName(scored.groupBy(F.col(factor).alias("level")).agg(F.avg("w").alias("mean")).withColumn("feature", F.lit(factor)))
    return _rounded(found, "mean")


_COUNTS_SQL = f"count(*) FILTER (WHERE f = 1) AS n1, count(*) FILTER (WHERE f = 0) AS n0 FROM (SELECT INCIDENT_BOROUGH, {FALSE_ALARM_OR_ZERO} AS f FROM incidents)"


@query(
    "ml_odds_overall",
    f"""WITH c AS (SELECT {_COUNTS_SQL}) SELECT '(Intercept)' AS term, round(ln(n1 / n0), 6) AS estimate,
    round(sqrt(1.0 / n1 + 1.0 / n0), 6) AS std_error, round(n1 / n0, 6) AS odds FROM c""",
)
def ml_odds_overall(t):
    flagged = t.incidents.select(false_alarm_or_zero(F.col("INCIDENT_CLASSIFICATION")).alias("f"))
    return _rounded(odds_overall(flagged, "f"), "estimate", "std_error", "odds")


@query(
    "ml_odds_by_group",
    f"""WITH c AS (SELECT INCIDENT_BOROUGH AS g, {_COUNTS_SQL} GROUP BY 1), r AS (SELECT * FROM c ORDER BY g LIMIT 1)
    SELECT CASE WHEN c.g = r.g THEN '(Intercept)' ELSE concat('INCIDENT_BOROUGH', c.g) END AS term,
    round(CASE WHEN c.g = r.g THEN ln(c.n1 / c.n0) ELSE ln(c.n1 / c.n0) - ln(r.n1 / r.n0) END, 6) AS estimate,
    round(sqrt(1.0 / c.n1 + 1.0 / c.n0 + CASE WHEN c.g = r.g THEN 0 ELSE 1.0 / r.n1 + 1.0 / r.n0 END), 6) AS std_error,
    round(CASE WHEN c.g = r.g THEN c.n1 / c.n0 ELSE (c.n1 / c.n0) / (r.n1 / r.n0) END, 6) AS odds FROM c, r""",
)
def ml_odds_by_group(t):
    flagged = t.incidents.select("INCIDENT_BOROUGH", false_alarm_or_zero(F.col("INCIDENT_CLASSIFICATION")).alias("f"))
    return _rounded(odds_by_group(flagged, "f", "INCIDENT_BOROUGH"), "estimate", "std_error", "odds")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    # Sums taken in another order may differ in the last bits; 0.0 is added to turn -0.0 into 0.0.
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


@query("ml_knn", f"WITH {_PARTS_SQL} {nearest('train', 'validate')}")
def ml_knn(t):
    train, validate = _divided(t)
    predicted = fit_knn(train, "ZIPCODE", LABEL, FEATURES).predict(validate)
    return predicted.where(F.col("prediction").isNotNull()).select("ZIPCODE", "prediction")


@query(
    "ml_knn_many",
    f"""WITH h AS (SELECT BIN, CAST(count(*) FILTER (WHERE ALPHA = 'H0') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE ALPHA = 'H1') AS DOUBLE) AS b,
      max(LATITUDE) AS c, max(LONGITUDE) AS d, CASE WHEN count(*) FILTER (WHERE LAST_INSP_STAT = 'APPROVAL') > 7 THEN 1 ELSE 0 END AS label
      FROM inspections GROUP BY BIN),
    s AS ({split('h', 'BIN')}),
    near AS (SELECT q.BIN, t.label, row_number() OVER (PARTITION BY q.BIN ORDER BY
        (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c) + (q.d - t.d) * (q.d - t.d), t.BIN) AS r
      FROM s q, s t WHERE q.split <> 'train' AND t.split = 'train'),
    votes AS (SELECT BIN, label, count(*) AS n FROM near WHERE r <= 5 GROUP BY BIN, label)
    SELECT BIN, label AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY BIN ORDER BY n DESC, label) = 1""",
)
def ml_knn_many(t):
    """Many points, so they go through the cells (more than ``max_pivots``): every building outside the training part is predicted."""
    count = lambda level: F.count_if(F.col("ALPHA") == level).cast("double")
    buildings = t.inspections.groupBy("BIN").agg(
        count("H0").alias("a"),
        count("H1").alias("b"),
        F.max("LATITUDE").alias("c"),
        F.max("LONGITUDE").alias("d"),
        (F.count_if(F.col("LAST_INSP_STAT") == "APPROVAL") > 7).cast("int").alias("label"),
    )
    buildings = split_exact(materialise(buildings, "buildings"), "BIN")
    model = fit_knn(buildings.where("split = 'train'"), "BIN", "label", ["a", "b", "c", "d"], k=5, max_pivots=64)
    return model.predict(buildings.where("split <> 'train'")).select("BIN", "prediction")


_FACTOR_SQL = f"""WITH c AS (SELECT INCIDENT_BOROUGH AS g, count(*) FILTER (WHERE f = 1) * 3.0 AS n1, count(*) FILTER (WHERE f = 0) AS n0
    FROM (SELECT INCIDENT_BOROUGH, {FALSE_ALARM_OR_ZERO} AS f FROM incidents) GROUP BY 1), r AS (SELECT * FROM c ORDER BY g LIMIT 1)
    SELECT CASE WHEN c.g = r.g THEN '(Intercept)' ELSE concat('INCIDENT_BOROUGH_', c.g) END AS term,
    round(CASE WHEN c.g = r.g THEN ln(c.n1 / c.n0) ELSE ln(c.n1 / c.n0) - ln(r.n1 / r.n0) END, 4) AS estimate FROM c, r"""


@query("ml_logit_one_factor", _FACTOR_SQL)
def ml_logit_one_factor(t):
    """The weighted fit with one factor, whose estimates have a closed form."""
    flagged = t.incidents.select("INCIDENT_BOROUGH", false_alarm_or_zero(F.col("INCIDENT_CLASSIFICATION")).alias("f"))
    weight = F.when(F.col("f") == 1, 3.0).otherwise(1.0)
    found = fit_logistic(flagged, "f", [], ["INCIDENT_BOROUGH"], weight).coefficients(t.spark)
    return found.select("term", (F.round("estimate", 4) + F.lit(0.0)).alias("estimate"))


_COMPLETE = " AND ".join(f"{f} IS NOT NULL" for f in FEATURE_NAMES)


@query("ml_score_all_rows", f"WITH {ZIP_FEATURES} SELECT ZIPCODE, ({_COMPLETE}) AS scored FROM zf")
def ml_score_all_rows(t):
    """Every zip comes back from the model; those with a NULL feature without a score."""
    divided = split_exact(features_of(t), "ZIPCODE")
    scored = fit_logistic(divided.where("split = 'train'"), LABEL, FEATURES).score(divided)
    return scored.select("ZIPCODE", (F.col("link").isNotNull() & F.col("probability").between(0, 1)).alias("scored"))


def _kernel_bayes_sql() -> str:
    """The estimator step by step: bandwidths, binned weights, smoothing, two interpolations, posterior."""
    long = lambda source: " UNION ALL ".join(
        f"SELECT ZIPCODE, false_alarms_above_below_median AS y, '{f}' AS f, CAST({f} AS DOUBLE) AS x FROM {source}"
        for f in FEATURE_NAMES
    )
    return f"""WITH {_PARTS_SQL},
    tv AS (SELECT * FROM ({long('train')}) WHERE x IS NOT NULL),
    st AS (SELECT y, f, count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd,
        (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34 AS iq FROM tv GROUP BY y, f),
    bws AS (SELECT *, 0.9 * CASE WHEN least(coalesce(sd, 0), iq) > 0 THEN least(coalesce(sd, 0), iq)
        WHEN sd > 0 THEN sd ELSE 1.0 END * pow(n, -0.2) AS bw FROM st),
    sh AS (SELECT y, f, n, bw, lo - 3 * bw AS low, (hi - lo + 6 * bw) / 511 AS step,
        lo - 7 * bw AS wlow, (hi - lo + 14 * bw) / 511 AS wstep FROM bws),
    pl AS (SELECT tv.y, tv.f, n, (x - wlow) / wstep AS p FROM tv JOIN sh USING (y, f)),
    cells AS (SELECT y, f, cell, sum(w / n) AS w FROM (
        SELECT y, f, n, floor(p) AS cell, floor(p) + 1 - p AS w FROM pl
        UNION ALL SELECT y, f, n, floor(p) + 1, p - floor(p) FROM pl) GROUP BY y, f, cell),
    grid AS (SELECT i FROM range(512) r(i)),
    smooth AS (SELECT y, f, i, sum(w * exp(-0.5 * pow((i - cell) * wstep / bw, 2))) / (bw * sqrt(2 * pi())) AS d
        FROM sh JOIN cells USING (y, f), grid GROUP BY y, f, i, bw),
    spots AS (SELECT y, f, i, (low + i * step - wlow) / wstep AS s FROM sh, grid),
    dens AS (SELECT k.y, k.f, k.i, a.d + (b.d - a.d) * (s - least(floor(s), 510)) AS d FROM spots k
        JOIN smooth a ON a.y = k.y AND a.f = k.f AND a.i = least(floor(s), 510)
        JOIN smooth b ON b.y = k.y AND b.f = k.f AND b.i = least(floor(s), 510) + 1),
    asked AS (SELECT v.ZIPCODE, sh.y, sh.f, least(greatest((x - low) / step, 0), 511) AS s
        FROM ({long('validate')}) v JOIN sh ON sh.f = v.f WHERE x IS NOT NULL),
    read AS (SELECT q.ZIPCODE, q.y, q.f, a.d + (b.d - a.d) * (s - least(floor(s), 510)) AS d FROM asked q
        JOIN dens a ON a.y = q.y AND a.f = q.f AND a.i = least(floor(s), 510)
        JOIN dens b ON b.y = q.y AND b.f = q.f AND b.i = least(floor(s), 510) + 1),
    logs AS (SELECT ZIPCODE, y, sum(ln(CASE WHEN d <= 0 THEN 0.001 ELSE d END))
        + ln((SELECT count(*) FROM train t WHERE t.false_alarms_above_below_median = read.y)) AS l
        FROM read GROUP BY ZIPCODE, y)
    SELECT v.ZIPCODE, round(1 / (1 + exp(l0.l - l1.l)), 6) AS probability FROM validate v
    LEFT JOIN logs l0 ON l0.ZIPCODE = v.ZIPCODE AND l0.y = 0
    LEFT JOIN logs l1 ON l1.ZIPCODE = v.ZIPCODE AND l1.y = 1"""


@query("ml_kde_naive_bayes", _kernel_bayes_sql())
def ml_kde_naive_bayes(t):
    train, validate = _divided(t)
    predicted = fit_kernel_bayes(train, LABEL, FEATURES).predict(validate)
    return _rounded(predicted.select("ZIPCODE", "probability"), "probability")


_ZIP_FOREST = forest("train", "validate", "ZIPCODE", LABEL, FEATURE_NAMES, weights=(1, 1))


@query(
    "ml_random_forest",
    f"WITH RECURSIVE {_PARTS_SQL}, {_ZIP_FOREST} SELECT ZIPCODE, round(probability, 6) AS probability FROM validate LEFT JOIN f_scores USING (ZIPCODE)",
)
def ml_random_forest(t):
    train, validate = _divided(t)
    scored = fit_forest(train, LABEL, FEATURES, key="ZIPCODE").score(validate)
    return _rounded(scored.select("ZIPCODE", "probability"), "probability")


@query("ml_forest_rows", f"WITH {_PARTS_SQL} SELECT ZIPCODE, ({_COMPLETE}) AS scored FROM validate")
def ml_forest_rows(t):
    """The rows of ``ml_random_forest``: every zip of the part, with a probability unless a feature is missing."""
    return ml_random_forest(t).select("ZIPCODE", (F.coalesce(F.col("probability").between(0, 1), F.lit(False))).alias("scored"))


_BALANCED = forest("train", "validate", "STARFIRE_INCIDENT_ID", "false_alarm", FEATURE_NAMES, FACTORS, (1, 10), balanced=True)


def _balanced_forest(t):
    divided = split_exact(_labelled_incidents(t), "STARFIRE_INCIDENT_ID")
    train, validate = divided.where("split = 'train'"), divided.where("split = 'validate'")
    return fit_forest(train, "false_alarm", FEATURES, FACTORS, (1.0, 10.0), balanced=True, key="STARFIRE_INCIDENT_ID"), validate


@query(
    "ml_random_forest_balanced",
    f"WITH RECURSIVE {_INCIDENT_PARTS_SQL}, {_BALANCED} SELECT STARFIRE_INCIDENT_ID, round(probability, 6) AS probability FROM f_scores",
)
def ml_random_forest_balanced(t):
    model, validate = _balanced_forest(t)
    return _rounded(model.score(validate).select("STARFIRE_INCIDENT_ID", "probability"), "probability")


@query(
    "ml_forest_draws",
    f"""WITH RECURSIVE {_INCIDENT_PARTS_SQL}, {_BALANCED} SELECT CAST(tree AS INTEGER) AS tree, s AS outcome, CAST(sum(m) AS BIGINT) AS drawn,
    count(*) AS different_rows, CAST(sum(rn * m) AS BIGINT) AS row_sum FROM f_draws GROUP BY tree, s""",
)
def ml_forest_draws(t):
    """What each tree of the balanced forest was grown on: as many rows of either class, drawn by hash."""
    model, _ = _balanced_forest(t)
    return model.draws.groupBy("tree", "outcome").agg(
        F.sum("n").alias("drawn"), F.count(F.lit(1)).alias("different_rows"), F.sum(F.col("row") * F.col("n")).alias("row_sum")
    )


@query(
    "ml_class_weight",
    f"""SELECT count(*) FILTER (WHERE f = 0) / count(*) FILTER (WHERE f = 1) AS weight FROM (SELECT {FALSE_ALARM} AS f FROM incidents)""",
)
def ml_class_weight(t):
    flagged = t.incidents.select(false_alarm(F.col("INCIDENT_CLASSIFICATION")).alias("f"))
    return flagged.agg(F.first(class_weight(flagged, "f")).alias("weight"))


# -- evaluation --------------------------------------------------------------------------


def _scored(t) -> DataFrame:
    """Incidents scored by their zip's share of false alarms, with a hard prediction."""
    flagged = t.incidents.select(
        "STARFIRE_INCIDENT_ID", "ZIPCODE", false_alarm(F.col("INCIDENT_CLASSIFICATION")).alias("truth")
    ).where(F.col("truth").isNotNull())
    rates = flagged.groupBy("ZIPCODE").agg(F.avg("truth").alias("score"))
    overall = flagged.agg(F.avg("truth")).scalar()
    scored = lookup_join(flagged, rates, "ZIPCODE")
    return scored.withColumn("prediction", F.when(F.col("score") > overall, 1).otherwise(0))


_CELLS_SQL = """count(*) FILTER (WHERE prediction = 0 AND truth = 0) AS tn, count(*) FILTER (WHERE prediction = 1 AND truth = 0) AS fp,
    count(*) FILTER (WHERE prediction = 0 AND truth = 1) AS fn, count(*) FILTER (WHERE prediction = 1 AND truth = 1) AS tp"""


@query("eval_confusion", f"WITH {SCORED} SELECT {_CELLS_SQL} FROM scored")
def eval_confusion(t):
    return evaluation.confusion(_scored(t), "prediction", "truth")


@query(
    "eval_threshold",
    """WITH r AS (SELECT BIN, count(*) FILTER (WHERE LAST_INSP_STAT = 'APPROVAL') / nullif(count(LAST_INSP_STAT), 0) AS p
    FROM inspections GROUP BY BIN) SELECT BIN, CASE WHEN p > 0.7 THEN 1 WHEN p <= 0.7 THEN 0 END AS prediction FROM r""",
)
def eval_threshold(t):
    rates = t.inspections.groupBy("BIN").agg(approval_rate(F.col("LAST_INSP_STAT") == "APPROVAL").alias("p"))
    return rates.select("BIN", above(F.col("p")).alias("prediction"))


@query(
    "eval_metrics",
    f"""WITH {SCORED}, c AS (SELECT {_CELLS_SQL} FROM scored) SELECT *, (tn + tp) / nullif(tn + fp + fn + tp, 0) AS accuracy,
    tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c""",
)
def eval_metrics(t):
    return evaluation.metrics(_scored(t), "prediction", "truth")


def _auc_sql(score: str) -> str:
    return f"""WITH {SCORED}, d AS (SELECT {score} AS s, count(*) FILTER (WHERE truth = 1) AS pos,
    count(*) FILTER (WHERE truth = 0) AS neg FROM scored GROUP BY 1),
    w AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg + neg / 2 AS beaten FROM d)
    SELECT round(sum(pos * beaten) / (sum(pos) * sum(neg)), 6) AS auc FROM w"""


@query("eval_auc_hard", _auc_sql("prediction"))
def eval_auc_hard(t):
    return _rounded(evaluation.auc(_scored(t), "prediction", "truth"), "auc")


@query("eval_auc_score", _auc_sql("score"))
def eval_auc_score(t):
    return _rounded(evaluation.auc(_scored(t), "score", "truth"), "auc")


@query(
    "eval_calibration",
    f"""WITH {SCORED}, b AS (SELECT greatest(1, CAST(ceil(score * 10) AS INT)) AS bin, count(*) AS n,
    count(*) FILTER (WHERE truth = 0) AS events FROM scored GROUP BY 1)
    SELECT CAST(i AS INT) AS bin, (i - 0.5::DOUBLE) / 10 AS midpoint, coalesce(n, 0) AS n, coalesce(events, 0) AS events, events / n AS share
    FROM range(1, 11) r(i) LEFT JOIN b ON b.bin = i""",
)
def eval_calibration(t):
    return evaluation.calibration(_scored(t), "truth", "score", 0)


@query(
    "eval_calibration_hard",
    f"""WITH {SCORED}, b AS (SELECT greatest(1, CAST(ceil(truth * 10) AS INT)) AS bin, count(*) AS n,
    count(*) FILTER (WHERE prediction = 1) AS events FROM scored GROUP BY 1)
    SELECT CAST(i AS INT) AS bin, (i - 0.5::DOUBLE) / 10 AS midpoint, coalesce(n, 0) AS n, coalesce(events, 0) AS events, events / n AS share
    FROM range(1, 11) r(i) LEFT JOIN b ON b.bin = i""",
)
def eval_calibration_hard(t):
    """Hard labels with the roles swapped: the prediction's share over the true label."""
    return evaluation.calibration(_scored(t), "prediction", "truth", 1)


@query(
    "eval_model_rows",
    f"""WITH {_PARTS_SQL} SELECT m AS model, count(*) FILTER (WHERE m = 'kernel_bayes' OR ({_COMPLETE})) AS n
    FROM validate, (VALUES ('logistic'), ('knn'), ('kernel_bayes'), ('forest')) models(m)
    WHERE false_alarms_above_below_median IS NOT NULL GROUP BY m""",
)
def eval_model_rows(t):
    """How many rows each line of the model table counts."""
    return eval_model_table(t).select("model", F.expr("tn + fp + fn + tp").alias("n"))


def _model_rows_sql(models: dict[str, str], truth: str, rows: str, key: str) -> str:
    """The comparison table; ``models``: for each the table of its hard predictions by key."""
    scored = " UNION ALL ".join(
        f"SELECT '{name}' AS model, {truth} AS truth, prediction FROM {rows} LEFT JOIN {source} USING ({key})" for name, source in models.items()
    )
    return f"""m AS (SELECT model, {_CELLS_SQL} FROM ({scored}) GROUP BY model),
    measured AS (SELECT *, (tn + tp) / nullif(tn + fp + fn + tp, 0) AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
      (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS auc FROM m)"""


_HARD = "CASE WHEN probability > 0.7 THEN 1 WHEN probability <= 0.7 THEN 0 END AS prediction"
_BAYES_TABLES, _BAYES_ROWS = _kernel_bayes_sql().removeprefix(f"WITH {_PARTS_SQL},").rsplit("SELECT v.ZIPCODE", 1)


@query(
    "eval_model_table",
    f"""WITH RECURSIVE {_PARTS_SQL}, {_BAYES_TABLES}, {_ZIP_FOREST}, {logistic('train', LABEL, FEATURE_NAMES)},
    p_logistic AS (SELECT ZIPCODE, CASE WHEN link > ln(0.7 / 0.3) THEN 1 WHEN link <= ln(0.7 / 0.3) THEN 0 END AS prediction
      FROM (SELECT ZIPCODE, {link(FEATURE_NAMES)} AS link FROM validate, g_fit)),
    p_knn AS ({nearest('train', 'validate')}), p_bayes AS (SELECT ZIPCODE, {_HARD} FROM (SELECT v.ZIPCODE {_BAYES_ROWS})),
    p_forest AS (SELECT ZIPCODE, {_HARD} FROM f_scores),
    {_model_rows_sql({'logistic': 'p_logistic', 'knn': 'p_knn', 'kernel_bayes': 'p_bayes', 'forest': 'p_forest'}, LABEL, 'validate', 'ZIPCODE')}
    SELECT *, auc = max(auc) OVER () AS best FROM measured""",
)
def eval_model_table(t):
    return zips_in_focus.compare_zip_models(features_of(t))


@query(
    "eval_refit_zips",
    f"""WITH {_PARTS_SQL}, known AS (SELECT * FROM s WHERE split <> 'test'), test AS (SELECT * FROM s WHERE split = 'test'),
    p AS ({nearest('known', 'test')}),
    scored AS (SELECT prediction, false_alarms_above_below_median AS truth FROM test LEFT JOIN p USING (ZIPCODE)),
    cm AS (SELECT {_CELLS_SQL} FROM scored) SELECT 'knn' AS model, *, (tn + tp) / nullif(tn + fp + fn + tp, 0) AS accuracy,
    tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
    (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS auc FROM cm""",
)
def eval_refit_zips(t):
    return zips_in_focus.refit_and_test(features_of(t))


def _focus_incidents(t) -> DataFrame:
    features = features_of(t)
    focus = materialise(zips_in_focus.zips_in_focus(features), "focus")
    return top_alarm_boxes.focus_incidents(t.incidents, focus, features)


_FOCUS_SQL = f"""{_PARTS_SQL}, known AS (SELECT * FROM s WHERE split <> 'test'), near AS ({nearest('known', 'zf')}), {FOCUS_INCIDENTS},
    parts AS ({split('fire', 'STARFIRE_INCIDENT_ID')}), box_train AS (SELECT * FROM parts WHERE split = 'train'),
    box_validate AS (SELECT * FROM parts WHERE split = 'validate'), box_test AS (SELECT * FROM parts WHERE split = 'test'),
    box_known AS (SELECT * FROM parts WHERE split <> 'test')"""
_BOX_LINK = link(FEATURE_NAMES, FACTORS)


def _box_logistic(train: str) -> str:
    return logistic(train, "false_alarm", FEATURE_NAMES, FACTORS, _WEIGHT_SQL.format(rows=train))


def _box_predictions(rows: str) -> str:
    hard = "CASE WHEN link > ln(0.7 / 0.3) THEN 1 WHEN link <= ln(0.7 / 0.3) THEN 0 END AS prediction"
    return f"p_logistic AS (SELECT STARFIRE_INCIDENT_ID, {hard} FROM (SELECT STARFIRE_INCIDENT_ID, {_BOX_LINK} AS link FROM {rows}, g_fit))"


_BOX_FOREST = forest("box_train", "box_validate", "STARFIRE_INCIDENT_ID", "false_alarm", FEATURE_NAMES, FACTORS, (1, 10), balanced=True)


@query(
    "eval_box_model_table",
    f"""WITH RECURSIVE {_FOCUS_SQL}, {_box_logistic('box_train')}, {_box_predictions('box_validate')}, {_BOX_FOREST},
    p_forest AS (SELECT STARFIRE_INCIDENT_ID, {_HARD} FROM f_scores),
    {_model_rows_sql({'logistic': 'p_logistic', 'forest': 'p_forest'}, 'false_alarm', 'box_validate', 'STARFIRE_INCIDENT_ID')}
    SELECT *, auc = max(auc) OVER () AS best FROM measured""",
)
def eval_box_model_table(t):
    return top_alarm_boxes.compare_box_models(_focus_incidents(t))


@query(
    "eval_refit_boxes",
    f"""WITH RECURSIVE {_FOCUS_SQL}, {_box_logistic('box_known')}, {_box_predictions('box_test')},
    {_model_rows_sql({'logistic': 'p_logistic'}, 'false_alarm', 'box_test', 'STARFIRE_INCIDENT_ID')} SELECT * FROM measured""",
)
def eval_refit_boxes(t):
    return top_alarm_boxes.refit_and_test(_focus_incidents(t))


@query(
    "job_top_alarm_boxes",
    f"""WITH RECURSIVE {_FOCUS_SQL}, {_box_logistic('box_known')}, linked AS (SELECT ZIPCODE, ALARM_BOX_NUMBER, {_BOX_LINK} AS link FROM parts, g_fit)
    SELECT ZIPCODE AS zip, ALARM_BOX_NUMBER AS alarm_box FROM linked QUALIFY rank() OVER (ORDER BY link DESC) <= 10""",
)
def job_top_alarm_boxes(t):
    return top_alarm_boxes.top_alarm_boxes(_focus_incidents(t))


@query(
    "job_box_scores",
    f"""WITH RECURSIVE {_FOCUS_SQL}, {_box_logistic('box_known')} SELECT STARFIRE_INCIDENT_ID, round({_BOX_LINK}, 6) AS link FROM parts, g_fit""",
)
def job_box_scores(t):
    """What the ranking goes by: the log-odds of every incident in focus."""
    incidents = _focus_incidents(t)
    model = top_alarm_boxes.weighted_logistic(incidents.where("split <> 'test'"))
    return _rounded(model.score(incidents).select("STARFIRE_INCIDENT_ID", "link"), "link")
