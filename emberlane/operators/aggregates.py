"""Aggregates with stated NULL behaviour, medians, pivots and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A pivot makes one column per value; more values than this point to a wrong column.
MAX_PIVOT_VALUES = 1000


def strict_sum(value: Column) -> Column:
    """Sum that is NULL as soon as one value is NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def count_matching(value: Column, labels: Sequence[str]) -> Column:
    """Number of rows whose value is one of ``labels``; NULL values do not count."""
    return F.count_if(value.isin(list(labels)))


def approval_rate(approved: Column) -> Column:
    """Share of TRUE among the non-NULL flags; NULL when there are none."""
    return F.try_divide(F.count_if(approved), F.count(approved))


def weighted_median(value: Column | str, weight: Column | str, strict: bool = False) -> Column:
    """Exact median of pre-counted values: ``weight`` is how often each value occurs.

    With ``strict`` one NULL value makes the median NULL. The state per group is
    its number of distinct values, which pre-counting also makes the number of
    rows a hot group sends to one task.
    """
    value = F.col(value) if isinstance(value, str) else value
    weight = F.col(weight) if isinstance(weight, str) else weight
    median = F.percentile(value, F.lit(0.5), weight)
    return F.when(F.count_if(value.isNull()) == 0, median) if strict else median


def median_by(df: DataFrame, keys: Sequence[str], value: Column, name: str, strict: bool = False) -> DataFrame:
    """Exact grouped median of a value from a bounded domain, such as a day number."""
    counted = df.select(*keys, value.alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(weighted_median("_v", "_n", strict).alias(name))


def median_of(df: DataFrame, column: str) -> Column:
    """Exact median of one column over the whole table, as a scalar usable in expressions."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(weighted_median(column, "_n")).scalar()


def approx_median_by(df: DataFrame, keys: Sequence[str], value: Column, name: str, accuracy: int = 10000) -> DataFrame:
    """Approximate grouped median for values with too many distinct ones to keep exactly."""
    return df.groupBy(*keys).agg(F.percentile_approx(value, 0.5, accuracy).alias(name))


def center_on_median(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add ``new = old - median(old)`` for each old → new pair."""
    return df.withColumns({new: F.col(old) - median_of(df, old) for old, new in columns.items()})


def count_distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Number of distinct value combinations; NULL counts as a value."""
    return df.select(*columns).distinct().agg(F.count(F.lit(1)).alias("n"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str, limit: int = MAX_PIVOT_VALUES) -> list:
    """The sorted distinct values of a category column, NULL last; more than ``limit`` are an error."""
    rows = df.select(column).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values")
    values = [r[0] for r in rows]
    return sorted(v for v in values if v is not None) + ([None] if None in values else [])


def pivot_counts(column: str, values: Sequence, prefix: str, where: Column | None = None) -> list[Column]:
    """One count per value as aggregate columns ``prefix + value``; NULL is named NA.

    Plain conditional counts: they share one aggregation with whatever else is
    computed for the group, and a missing combination is 0 by itself.
    """
    where = F.lit(True) if where is None else where
    return [
        F.count_if(F.col(column).eqNullSafe(F.lit(v)) & where).alias(prefix + ("NA" if v is None else str(v))) for v in values
    ]


def pivot_count(
    df: DataFrame, keys: Sequence[str], column: str, prefix: str, values: Sequence | None = None, limit: int = MAX_PIVOT_VALUES
) -> DataFrame:
    """Row counts per key, spread to one column per value. Without ``values`` they are looked up first, ``limit`` at most."""
    values = distinct_values(df, column, limit) if values is None else values
    return df.groupBy(*keys).agg(*pivot_counts(column, values, prefix))


def column_means(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in df.columns])


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count of every column in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def share_of_group(df: DataFrame, keys: Sequence[str], column: str, name: str = "share") -> DataFrame:
    """Rows per (keys, column) with each count's share of its key's total.

    The window sees one row per distinct value of ``column``, not the raw rows.
    """
    from pyspark.sql import Window

    counted = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn(name, F.try_divide("n", F.sum("n").over(Window.partitionBy(*keys))))
