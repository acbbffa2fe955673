"""Filters that need more than a predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_first_row(df: DataFrame, ordinal: str) -> DataFrame:
    """Drop the row with the smallest ordinal; row position means nothing in Spark."""
    return df.where(~F.col(ordinal).eqNullSafe(df.agg(F.min(ordinal)).scalar()))


def any_gate(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """All rows if any row's key is in ``wanted``, else none. Only distinct keys are compared."""
    hits = df.select(key).distinct().join(wanted.select(key).distinct(), key, "left_semi")
    return df.where(hits.exists())


def in_derived_set(df: DataFrame, column: str, text: str) -> DataFrame:
    """Keep rows whose value is among the distinct values containing ``text``.

    The set is a function of the value itself, so membership is the predicate and
    no semi-join is needed.
    """
    return df.where(F.col(column).contains(text))
