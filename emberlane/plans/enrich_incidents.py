"""Incidents with the first matching box, certificate, inspection and violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.functions.dates import days_between, parse_mdy, parse_mdy_hms, year_after
from emberlane.functions.logic import collapse_false_alarms, corrected_borough, recode_boroughs
from emberlane.functions.text import box_key, drop_first_char, pad_box_keep
from emberlane.operators.filters import drop_first_row
from emberlane.operators.joins import first_rows_side_by_side, keep_first_join, lookup_join

# Incident columns that are left out.
_NOT_KEPT = [
    "POLICEPRECINCT",
    "CITYCOUNCILDISTRICT",
    "COMMUNITYDISTRICT",
    "COMMUNITYSCHOOLDISTRICT",
    "CONGRESSIONALDISTRICT",
    "STARFIRE_INCIDENT_ID",
    "ALARM_BOX_BOROUGH",
    "ALARM_BOX_LOCATION",
    "INCIDENT_BOROUGH",
]


def current_certificates(fitness: DataFrame, after_year: int, ordinal: str) -> DataFrame:
    """Certificates with repaired boroughs, without the first row, that expire after ``after_year``."""
    repaired = fitness.withColumn("BOROUGH", corrected_borough(F.col("BOROUGH"), F.col("PREM_ADDR")))
    cleaned = recode_boroughs(drop_first_row(repaired, ordinal)).withColumn("EXPIRES_ON", parse_mdy(F.col("EXPIRES_ON")))
    return cleaned.where(year_after(F.col("EXPIRES_ON"), after_year))


def enrich_incidents(
    dispatch: DataFrame,
    boxes: DataFrame,
    fitness: DataFrame,
    inspections: DataFrame,
    violations: DataFrame,
    after_year: int = 2020,
    ordinal: str = "ordinal",
) -> DataFrame:
    """Each incident with its box's borough, its zip's first certificate, inspection and
    violation, days since that inspection, and the class as '1' / '0'.

    "First" is by the ``ordinal`` column of each table. A table that lacks one of the columns named here
    is an error.
    """
    located = boxes.select(
        box_key(drop_first_char(F.col("BOROBOX"))).alias("ALARM_BOX_NUMBER"),
        "BOROUGH",
        ordinal,
    )
    incidents = dispatch.withColumns(
        {
            "ALARM_BOX_NUMBER": box_key(pad_box_keep(F.col("ALARM_BOX_NUMBER"))),
            "ZIPCODE": F.col("ZIPCODE").cast("long"),
            "INCIDENT_DATETIME": F.to_date(parse_mdy_hms(F.col("INCIDENT_DATETIME"))),
        }
    )
    enriched = keep_first_join(incidents, located, "ALARM_BOX_NUMBER", ordinal)
    wanted = [
        (current_certificates(fitness, after_year, ordinal), ["EXPIRES_ON", "PREM_ADDR"]),
        (recode_boroughs(inspections), ["LAST_VISIT_DT", "LAST_FULL_INSP_DT", "LAST_INSP_STAT"]),
        (recode_boroughs(violations), ["VIO_LAW_NUM", "VIO_LAW_DESC", "VIO_DATE", "ACTION"]),
    ]
    by_zip = [(table.withColumn("ZIPCODE", F.col("POSTCODE").cast("long")), columns) for table, columns in wanted]
    enriched = lookup_join(enriched, first_rows_side_by_side(by_zip, "ZIPCODE", ordinal), "ZIPCODE")
    enriched = enriched.withColumn("LAST_FULL_INSP_DT", parse_mdy(F.col("LAST_FULL_INSP_DT")))
    return enriched.withColumns(
        {
            "days_after_last_inspection": days_between(F.col("INCIDENT_DATETIME"), F.col("LAST_FULL_INSP_DT")),
            "INCIDENT_CLASSIFICATION": collapse_false_alarms(F.col("INCIDENT_CLASSIFICATION")),
        }
    ).drop(*_NOT_KEPT)
