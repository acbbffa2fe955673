"""Projection helpers that check names, which Spark's own versions do not."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")


def drop_columns(df: DataFrame, *names: str, missing: str = "error") -> DataFrame:
    """Drop columns; an unknown name is an error unless ``missing="ignore"``."""
    if missing == "error":
        _require(df, names)
    return df.drop(*names)


def drop_containing(df: DataFrame, text: str) -> DataFrame:
    """Drop the columns whose name contains ``text``, ignoring case."""
    return df.select(*[c for c in df.columns if text.lower() not in c.lower()])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename old → new; an unknown old name is an error."""
    _require(df, names)
    return df.withColumnsRenamed(dict(names))


def cast_all(df: DataFrame, to: str = "double") -> DataFrame:
    """Cast every column; values that cannot be cast become NULL.

    Goes through text, so that any source type may be cast to any other.
    """
    return df.select(*[F.col(c).cast("string").try_cast(to).alias(c) for c in df.columns])


def suffix_clashes(
    left: DataFrame, right: DataFrame, by: Iterable[str], suffixes: tuple[str, str] = ("_x", "_y")
) -> tuple[DataFrame, DataFrame]:
    """Give non-key columns that both sides share a suffix, so that a join keeps both."""
    clash = [c for c in left.columns if c in right.columns and c not in set(by)]
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in clash}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in clash}),
    )


def preview(df: DataFrame, key: str, rows: int = 6) -> DataFrame:
    """The first rows by ``key``, transposed: one row per column, one column per row.

    All values are text. Only ``rows`` rows leave the top-n, so the numbering and
    the pivot work on a handful of cells.
    """
    from pyspark.sql import Window

    fields = df.columns
    top = df.orderBy(F.col(key).asc_nulls_last()).limit(rows)
    numbered = top.select(
        F.row_number().over(Window.orderBy(F.col(key).asc_nulls_last())).alias("_n"),
        *[F.col(c).cast("string").alias(c) for c in fields],
    )
    cells = numbered.unpivot("_n", fields, "field", "_value")
    return cells.groupBy("field").agg(
        *[F.max(F.when(F.col("_n") == i, F.col("_value"))).alias(f"row_{i}") for i in range(1, rows + 1)]
    )
