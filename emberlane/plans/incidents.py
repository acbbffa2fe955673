"""The cleaned incident table that several jobs start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.functions.dates import parse_mdy_hms, weekday_name
from emberlane.functions.logic import false_alarm, false_alarm_or_zero
from emberlane.functions.text import pad_box


def clean_incidents(dispatch: DataFrame, unclassified_as_zero: bool = False) -> DataFrame:
    """Add the false-alarm flag and time parts, parse the time and pad the box number."""
    label = false_alarm_or_zero if unclassified_as_zero else false_alarm
    parsed = dispatch.withColumns(
        {
            "false_alarm": label(F.col("INCIDENT_CLASSIFICATION")),
            "INCIDENT_DATETIME": parse_mdy_hms(F.col("INCIDENT_DATETIME")),
            "ALARM_BOX_NUMBER": pad_box(F.col("ALARM_BOX_NUMBER")),
        }
    )
    return parsed.withColumns(
        {
            "incident_month": F.month("INCIDENT_DATETIME"),
            "incident_hour": F.hour("INCIDENT_DATETIME"),
            "incident_weekday": weekday_name(F.col("INCIDENT_DATETIME")),
        }
    )


def false_alarms_by_borough(incidents: DataFrame) -> DataFrame:
    """False alarms per borough; unclassified incidents add nothing."""
    return incidents.groupBy("INCIDENT_BOROUGH").agg(F.sum("false_alarm").alias("number_of_false_alarms"))
