"""The year-partitioned Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_year(df: DataFrame, path: str, year: str = "year", max_rows_per_file: int = 0) -> None:
    """Write ``path/year=YYYY/…``; rows without a year go to the default partition.

    The rebalance hint gathers a year's rows into few files, and splits a year
    that holds much of the table over many tasks.
    """
    writer = df.hint("rebalance", F.col(year)).write.partitionBy(year)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(path)


def read_year(spark: SparkSession, path: str, value: int | None, year: str = "year") -> DataFrame:
    """Rows of one year (None: rows without a year); only that partition is listed and read."""
    table = spark.read.parquet(path)
    return table.where(F.col(year) == value) if value is not None else table.where(F.col(year).isNull())
