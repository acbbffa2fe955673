"""Incidents as a Parquet table partitioned by year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.functions.dates import parse_mdy_hms
from emberlane.sources import read_year, write_by_year


def partition_by_year(dispatch: DataFrame, path: str) -> None:
    """Write all incidents below ``path``, one folder per year of the incident."""
    write_by_year(dispatch.withColumn("year", F.year(parse_mdy_hms(F.col("INCIDENT_DATETIME")))), path)


def one_year(dispatch: DataFrame, path: str, year: int) -> DataFrame:
    """Write the partitioned table, then read one year of it."""
    partition_by_year(dispatch, path)
    return read_year(dispatch.sparkSession, path, year)
