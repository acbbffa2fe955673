"""Building-level features, one or more rows per building number (BIN)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlane.functions.constants import APPROVED_STATUS, FIRE_MARK
from emberlane.functions.dates import parse_mdy
from emberlane.functions.text import split_sum
from emberlane.operators.aggregates import MAX_PIVOT_VALUES, distinct_values, pivot_counts
from emberlane.operators.filters import in_derived_set
from emberlane.operators.joins import natural_left_join


def recent_fire_certificates(fitness: DataFrame, first_year: int = 2019, last_year: int = 2021) -> DataFrame:
    """Fire-related certificates per BIN that expire within the years, both included.

    Certificates with any missing column do not count.
    """
    complete = in_derived_set(fitness, "COF_TYPE", FIRE_MARK).na.drop("any")
    recent = complete.where(F.year(parse_mdy(F.col("EXPIRES_ON"))).between(first_year, last_year))
    return recent.groupBy("BIN").agg(F.count(F.lit(1)).alias("num_recent_fire_fitness_certs"))


def sprinklers(summary: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    return summary.select(
        "BIN",
        split_sum(F.col("NUM_SIAM_SPRINKLER")).alias("NUM_SIAM_SPRINKLER"),
        "SPRINKLER_TYPE",
        split_sum(F.col("NUM_SIAM_STANDPIPE")).alias("NUM_SIAM_STANDPIPE"),
        "STANDPIPE_TYPE",
        *more,
    )


def open_violations(summary: DataFrame) -> DataFrame:
    return summary.select("BIN", "NUM_OF_VIOLATION_NOTICES", "NUM_OF_VIOLATION_ORDER")


def inspection_profile(inspections: DataFrame, levels: Sequence | None = None, max_levels: int = MAX_PIVOT_VALUES) -> DataFrame:
    """Per BIN (0 and NULL left out): inspections per hazard level, approvals and approval rate.

    All counts come from one aggregation. Without ``levels`` the hazard levels are
    looked up first; more than ``max_levels`` are an error.
    """
    numbered = inspections.where(F.col("BIN") != 0)
    levels = distinct_values(numbered, "ALPHA", max_levels) if levels is None else levels
    approved = F.col("LAST_INSP_STAT") == APPROVED_STATUS
    counted = numbered.groupBy("BIN").agg(
        *pivot_counts("ALPHA", levels, "hazard_"),
        F.count_if(approved).alias("approved_TRUE"),
        F.count_if(~approved).alias("approved_FALSE"),
    )
    return counted.withColumn("proportion_approved", F.try_divide("approved_TRUE", F.expr("approved_TRUE + approved_FALSE")))


def bin_features(
    inspections: DataFrame,
    fitness: DataFrame,
    summary: DataFrame,
    first_year: int = 2019,
    last_year: int = 2021,
    levels: Sequence | None = None,
    one_row_per_bin: bool = False,
    pair_summaries: bool = False,
    max_levels: int = MAX_PIVOT_VALUES,
) -> DataFrame:
    """Building features: one row for each of a building's summary rows.

    ``pair_summaries`` joins the summary for its sprinklers and again for its violations, which
    gives m x m rows for m summary rows; ``one_row_per_bin`` keeps one summary row per building.
    """
    if one_row_per_bin:
        fields = [c for c in summary.columns if c != "BIN"]
        place = F.row_number().over(Window.partitionBy("BIN").orderBy(*fields))
        summary = summary.withColumn("_place", place).where("_place = 1").drop("_place")
    profile = inspection_profile(inspections, levels, max_levels)
    certificates = recent_fire_certificates(fitness, first_year, last_year)
    if pair_summaries:
        parts = (sprinklers(summary), certificates, open_violations(summary))
    else:
        counts = ["NUM_OF_VIOLATION_NOTICES", "NUM_OF_VIOLATION_ORDER"]
        parts = (sprinklers(summary, counts), certificates)
    joined = profile
    # BIN is never NULL on the left, so plain equality will do: all joins then share one
    # partitioning by BIN.
    for part in parts:
        joined = natural_left_join(joined, part, null_safe=False)
    filled = joined.fillna(0, ["num_recent_fire_fitness_certs", "NUM_OF_VIOLATION_NOTICES", "NUM_OF_VIOLATION_ORDER"])
    hazards = [c for c in profile.columns if c.startswith("hazard_")]
    return filled.select(
        "BIN",
        *hazards,
        "NUM_SIAM_SPRINKLER",
        "SPRINKLER_TYPE",
        "NUM_SIAM_STANDPIPE",
        "STANDPIPE_TYPE",
        "approved_TRUE",
        "approved_FALSE",
        "proportion_approved",
        "num_recent_fire_fitness_certs",
        "NUM_OF_VIOLATION_NOTICES",
        "NUM_OF_VIOLATION_ORDER",
    )
