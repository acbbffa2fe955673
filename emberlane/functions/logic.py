"""Conditional expressions with stated NULL behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.functions.constants import BOROUGH_BY_ADDRESS, BOROUGH_NAMES, FALSE_ALARM_LABELS, THRESHOLD


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice; a NULL condition gives NULL (``otherwise`` would give ``no``)."""
    return F.when(condition, yes).when(~condition, no)


def false_alarm(classification: Column) -> Column:
    """1 for a false alarm, 0 for any other incident, NULL when unclassified."""
    return if_else(classification.isin(FALSE_ALARM_LABELS), 1, 0)


def false_alarm_or_zero(classification: Column) -> Column:
    """As ``false_alarm`` but an unclassified incident counts as 0."""
    return F.when(classification.isin(FALSE_ALARM_LABELS), 1).otherwise(0)


def collapse_false_alarms(classification: Column) -> Column:
    """Class labels '1' (false alarm) and '0'; NULL is kept."""
    return if_else(classification.isin(FALSE_ALARM_LABELS), "1", "0")


def above(probability: Column, threshold: float = THRESHOLD) -> Column:
    """Hard prediction: 1 strictly above the threshold, else 0, NULL kept."""
    return if_else(probability > threshold, 1, 0)


def recode_boroughs(df: DataFrame) -> DataFrame:
    """Spell out borough codes in every string column, matching whole cells only."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.replace(BOROUGH_NAMES, subset=text) if text else df


def corrected_borough(borough: Column, address: Column) -> Column:
    """Fill a blank borough from the table of known addresses."""
    pairs = [F.lit(x) for pair in BOROUGH_BY_ADDRESS.items() for x in pair]
    known = F.try_element_at(F.create_map(*pairs), address)
    return F.when(borough == "", F.coalesce(known, borough)).otherwise(borough)
