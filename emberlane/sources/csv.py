"""CSV readers for the two blank-cell conventions the inputs use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.sources.schemas import SCHEMAS


def _read(spark: SparkSession, path: str, schema: T.StructType | str | None, null: str, multi_line: bool, strict: bool) -> DataFrame:
    """Columns are bound by the names in the header, whatever their order.

    A typed cell that does not parse is NULL. ``multi_line`` is for cells with line breaks in quotes; such
    files cannot be split over tasks. ``strict`` makes a record with too few or too many cells an error.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", null)
    reader = reader.option("multiLine", multi_line).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if schema is None:
        # Inferring types costs a full extra pass, so it is only for tables without a known schema.
        return reader.option("inferSchema", True).csv(path)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = reader.csv(path)
    missing = [f.name for f in wanted.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def clean_names(df: DataFrame) -> DataFrame:
    """Replace characters that are awkward in column names by an underscore."""
    return df.withColumnsRenamed({c: re.sub(r"[^A-Za-z0-9_]", "_", c) for c in df.columns})


def read_csv_null(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False, strict: bool = False
) -> DataFrame:
    """Blank cells and the text NA are NULL in every column."""
    df = _read(spark, path, schema, "NA", multi_line, strict)
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c in _string_columns(df)})


def read_csv_blank(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False, strict: bool = False
) -> DataFrame:
    """Blank text stays an empty string (NULL only in typed columns); names are cleaned.

    The text NA is missing here too.
    """
    # Only a marker no cell holds can keep "blank" and NA apart while reading.
    df = clean_names(_read(spark, path, schema, "", multi_line, strict))
    text = _string_columns(df)
    return df.withColumns({c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("NA")) for c in text})


def read_tables(spark: SparkSession, root: str, *names: str, multi_line: bool = False, strict: bool = False) -> dict[str, DataFrame]:
    """The input tables below ``root``, each from ``root/<name>.csv`` (a file or a folder of files) with its schema."""
    return {
        name: read_csv_null(spark, f"{root.rstrip('/')}/{name}.csv", SCHEMAS[name], multi_line, strict) for name in names or SCHEMAS
    }
