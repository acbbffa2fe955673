"""Catalogues of alarm boxes and of building addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.operators.ranking import sorted_distinct


def box_catalogue(dispatch: DataFrame, ordered: bool = True) -> DataFrame:
    """Distinct alarm boxes, in the order of their numbers unless something else follows that would undo it."""
    columns = ["ALARM_BOX_NUMBER", "ALARM_BOX_BOROUGH", "ALARM_BOX_LOCATION"]
    return sorted_distinct(dispatch, columns) if ordered else dispatch.select(*columns).distinct()


def address_catalogue(inspections: DataFrame) -> DataFrame:
    """Distinct buildings with their addresses; BIN 0 and NULL are left out."""
    columns = ["BIN", "POSTCODE", "BOROUGH", "Number", "Street", "LATITUDE", "LONGITUDE"]
    return inspections.where(F.col("BIN") != 0).select(*columns).distinct()
