"""Odds of a 0/1 outcome, overall and by one factor.

A logistic model with only an intercept, or with one factor, has a closed form:
log-odds of counts. One aggregation replaces an iterative fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, outcome: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.col(outcome) == 1).alias("n1"), F.count_if(F.col(outcome) == 0).alias("n0")
    )


def _log_odds() -> Column:
    # A group without one of the classes has no finite log-odds.
    return F.ln(F.try_divide("n1", F.nullif(F.col("n0"), F.lit(0))))


def _variance() -> Column:
    return F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n0"))


def odds_overall(df: DataFrame, outcome: str) -> DataFrame:
    """Intercept-only model: estimate (log-odds), standard error, odds."""
    return class_counts(df, outcome).select(
        F.lit("(Intercept)").alias("term"),
        _log_odds().alias("estimate"),
        F.sqrt(_variance()).alias("std_error"),
        F.exp(_log_odds()).alias("odds"),
    )


def odds_by_group(df: DataFrame, outcome: str, group: str) -> DataFrame:
    """One-factor model: the alphabetically first level is the intercept, others are odds ratios to it."""
    levels = (
        class_counts(df.where(F.col(group).isNotNull() & F.col(outcome).isNotNull()), outcome, group)
        .withColumn("logit", _log_odds())
        .withColumn("var", _variance())
    )
    reference = levels.agg(F.min_by(F.struct(group, "logit", "var"), group)).scalar()
    is_reference = F.col(group) == reference[group]
    estimate = F.when(is_reference, F.col("logit")).otherwise(F.col("logit") - reference["logit"])
    variance = F.when(is_reference, F.col("var")).otherwise(F.col("var") + reference["var"])
    return levels.select(
        F.when(is_reference, "(Intercept)").otherwise(F.concat(F.lit(group), F.col(group))).alias("term"),
        estimate.alias("estimate"),
        F.sqrt(variance).alias("std_error"),
        F.exp(estimate).alias("odds"),
    )


def class_weight(df: DataFrame, outcome: str) -> Column:
    """Weight of a positive row, negatives / positives, as a scalar."""
    return class_counts(df, outcome).agg(F.try_divide(F.first("n0"), F.first("n1"))).scalar()
