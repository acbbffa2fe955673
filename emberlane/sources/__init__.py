"""Typed CSV readers and the year-partitioned Parquet table."""

from emberlane.sources.csv import read_csv_blank, read_csv_null, read_tables
from emberlane.sources.partitioned import read_year, write_by_year
from emberlane.sources.schemas import SCHEMAS

__all__ = ["SCHEMAS", "read_csv_blank", "read_csv_null", "read_tables", "read_year", "write_by_year"]
