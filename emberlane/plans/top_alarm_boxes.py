"""The alarm boxes most likely to report false alarms, within the zip codes in focus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.functions.constants import FIRE_GROUPS, THRESHOLD
from emberlane.functions.dates import month_name
from emberlane.functions.logic import above
from emberlane.models import evaluation
from emberlane.models.forest import fit_forest
from emberlane.models.logistic import LogisticModel, fit_logistic
from emberlane.models.odds import class_weight
from emberlane.models.split import split_exact
from emberlane.operators.filters import any_gate
from emberlane.operators.joins import left_join_nullsafe, lookup_join
from emberlane.operators.ranking import top_n_with_ties
from emberlane.plans.incidents import clean_incidents
from emberlane.plans.zip_features import FEATURES
from emberlane.session import materialise

OUTCOME = "false_alarm"
FACTORS = ["incident_weekday", "incident_hour", "incident_month"]
_KEPT = ["STARFIRE_INCIDENT_ID", "ZIPCODE", "ALARM_BOX_NUMBER", OUTCOME, *FACTORS]


def focus_incidents(dispatch: DataFrame, focus: DataFrame, features: DataFrame, focus_mode: str = "per_row") -> DataFrame:
    """Fire-related incidents in the focus zips with time factors, zip features and a split label.

    ``focus_mode="any"`` keeps every incident as soon as one lies in a focus zip. The
    result is written once, since fitting and ranking read it many times.
    """
    fire = clean_incidents(dispatch).where(F.col("INCIDENT_CLASSIFICATION_GROUP").isin(FIRE_GROUPS))
    fire = fire.withColumn("ZIPCODE", F.col("ZIPCODE").cast("long"))
    if focus_mode == "any":
        fire, features = any_gate(fire, "ZIPCODE", focus), features.select("ZIPCODE", *FEATURES)
    else:
        # The focus carries its zips' features, so one join both chooses and adds.
        features = focus.select("ZIPCODE", *FEATURES).withColumn("_in_focus", F.lit(True))
    named = fire.withColumns(
        {"incident_month": month_name(F.col("INCIDENT_DATETIME")), "incident_hour": F.col("incident_hour").cast("string")}
    )
    complete = named.select(*_KEPT).na.drop("any")
    joined = lookup_join(complete, features, "ZIPCODE")
    if focus_mode != "any":
        joined = joined.where("_in_focus").drop("_in_focus")
    return split_exact(materialise(joined, "focus-incidents"), "STARFIRE_INCIDENT_ID")


def _part(incidents: DataFrame, *names: str) -> DataFrame:
    return incidents.where(F.col("split").isin(list(names)))


def weighted_logistic(train: DataFrame) -> LogisticModel:
    """Logistic model in which both classes have the same total weight."""
    positive = class_weight(train, OUTCOME)
    weight = F.when(F.col(OUTCOME) == 1, positive).otherwise(F.lit(1.0))
    return fit_logistic(train, OUTCOME, FEATURES, FACTORS, weight)


def compare_box_models(incidents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Weighted logistic model and class-balanced forest, scored on the validate part."""
    train, validate = _part(incidents, "train"), _part(incidents, "validate")
    forest = fit_forest(train, OUTCOME, FEATURES, FACTORS, class_weights=(1.0, 10.0), balanced=True, key="STARFIRE_INCIDENT_ID")
    hard = lambda scored: scored.withColumn("prediction", above(F.col("probability"), threshold))
    return evaluation.compare(
        [
            evaluation.model_row(hard(weighted_logistic(train).score(validate)), "logistic", "prediction", OUTCOME),
            evaluation.model_row(hard(forest.score(validate)), "forest", "prediction", OUTCOME),
        ]
    )


def refit_and_test(incidents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The logistic model refitted on train and validate, measured on the test part."""
    model = weighted_logistic(_part(incidents, "train", "validate"))
    scored = model.score(_part(incidents, "test")).withColumn("prediction", above(F.col("probability"), threshold))
    return evaluation.model_row(scored, "logistic", "prediction", OUTCOME)


def top_alarm_boxes(incidents: DataFrame, n: int = 10, per_box: bool = False) -> DataFrame:
    """(zip, alarm_box) of the ``n`` incidents scored highest by the refitted model, ties kept.

    Incidents are ranked, so a box can come up more than once; ``per_box`` ranks
    each box once by its highest score. A score depends on the zip and the time factors alone, so it is
    computed once for each of their combinations and box.
    """
    model = weighted_logistic(_part(incidents, "train", "validate"))
    return rank_boxes(incidents, model.score, n, per_box)


def rank_boxes(incidents: DataFrame, score: Callable[[DataFrame], DataFrame], n: int = 10, per_box: bool = False) -> DataFrame:
    """The ranking alone; ``score`` adds ``link`` to rows of distinct features."""
    alike = ["ZIPCODE", *FACTORS, *FEATURES]
    counted = incidents.groupBy(*alike, "ALARM_BOX_NUMBER").agg(F.count(F.lit(1)).alias("_incidents"))
    counted = materialise(counted, "box-features")
    scored = materialise(score(counted.select(*alike).distinct()).select(*alike, "link"), "feature-scores")
    boxes = left_join_nullsafe(counted, scored, alike)
    if per_box:
        boxes = boxes.groupBy("ZIPCODE", "ALARM_BOX_NUMBER").agg(F.max("link").alias("link"), F.lit(1).alias("_incidents"))
    top = top_n_with_ties(boxes, "link", n, "_incidents")
    # As many rows again as there were incidents behind each.
    repeated = top.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_incidents").cast("long"))))
    return repeated.select(
        F.col("ZIPCODE").alias("zip"), F.col("ALARM_BOX_NUMBER").alias("alarm_box")
    )
