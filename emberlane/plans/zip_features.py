"""Zip-level features: false alarms, inspections, certificates and violations per zip code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.functions.constants import APPROVED_STATUS, FIRE_MARK, VIOLATION_STATUSES
from emberlane.functions.dates import epoch_day, parse_mdy
from emberlane.functions.logic import false_alarm, if_else
from emberlane.operators.aggregates import center_on_median, median_of, strict_sum, weighted_median
from emberlane.operators.joins import left_join_nullsafe
from emberlane.session import materialise

# The model features, in the order they are used in.
FEATURES = [
    "last_inspection_status_vio",
    "days_from_median_cert_expiry_date",
    "days_from_median_last_full_inspection_date",
    "days_from_median_violation_date",
    "proportion_approved",
]
LABEL = "false_alarms_above_below_median"

_CENTERED = {
    "median_cert_expiry_date": "days_from_median_cert_expiry_date",
    "median_last_full_inspection_date": "days_from_median_last_full_inspection_date",
    "median_violation_date": "days_from_median_violation_date",
}


def _day(text: str) -> Column:
    return epoch_day(parse_mdy(F.col(text)))


def date_medians_by_zip(table: DataFrame, date: str, name: str) -> DataFrame:
    """Median day per POSTCODE. Rows are counted per date text first, so each text is parsed once per zip."""
    counted = table.groupBy("POSTCODE", date).agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", _day(date))
    return counted.groupBy(F.col("POSTCODE").alias("ZIPCODE")).agg(weighted_median("_day", "_n").alias(name))


def false_alarms_by_zip(dispatch: DataFrame) -> DataFrame:
    flagged = dispatch.select(F.col("ZIPCODE").cast("long"), false_alarm(F.col("INCIDENT_CLASSIFICATION")).alias("_flag"))
    return flagged.groupBy("ZIPCODE").agg(strict_sum(F.col("_flag")).alias("number_of_false_alarms"))


def inspections_by_zip(inspections: DataFrame) -> DataFrame:
    """Violation-type inspections, median inspection day and approval rate, in one pass over the table.

    The rate leaves out buildings without a number (BIN 0 or NULL), the others do not.
    """
    status, numbered = F.col("LAST_INSP_STAT"), F.col("BIN") != 0
    counted = inspections.groupBy("POSTCODE", "LAST_FULL_INSP_DT").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(status.isin(VIOLATION_STATUSES)).alias("_vio"),
        F.count_if((status == APPROVED_STATUS) & numbered).alias("_approved"),
        F.count_if(status.isNotNull() & numbered).alias("_rated"),
    )
    counted = counted.withColumn("_day", _day("LAST_FULL_INSP_DT"))
    return counted.groupBy(F.col("POSTCODE").alias("ZIPCODE")).agg(
        F.sum("_vio").alias("last_inspection_status_vio"),
        weighted_median("_day", "_n", strict=True).alias("median_last_full_inspection_date"),
        F.try_divide(F.sum("_approved"), F.sum("_rated")).alias("proportion_approved"),
    )


def zip_features(dispatch: DataFrame, inspections: DataFrame, fitness: DataFrame, violations: DataFrame) -> DataFrame:
    """One row per zip code that has all of its counts and dates."""
    fire = fitness.where(F.col("COF_TYPE").contains(FIRE_MARK))
    joined = false_alarms_by_zip(dispatch)
    for part in (
        inspections_by_zip(inspections),
        date_medians_by_zip(fire, "EXPIRES_ON", "median_cert_expiry_date"),
        date_medians_by_zip(violations, "VIO_DATE", "median_violation_date"),
    ):
        joined = left_join_nullsafe(joined, part, "ZIPCODE")
    # The city-wide medians below read this small table again; unless it is written first
    # they would repeat the scans.
    joined = materialise(joined, "zip-parts")
    centered = center_on_median(joined, _CENTERED).drop(*_CENTERED)
    # The rate is joined after incomplete rows are dropped, so it alone may be NULL.
    needed = [c for c in centered.columns if c != "proportion_approved"]
    complete = joined.na.drop("any", subset=["ZIPCODE", "number_of_false_alarms", "last_inspection_status_vio", *_CENTERED])
    middle = median_of(complete, "number_of_false_alarms")
    return centered.na.drop("any", subset=needed).select(
        "ZIPCODE",
        "number_of_false_alarms",
        "last_inspection_status_vio",
        *_CENTERED.values(),
        if_else(F.col("number_of_false_alarms") < middle, 0, 1).alias(LABEL),
        "proportion_approved",
    )
