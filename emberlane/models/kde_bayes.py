"""Naive Bayes with Gaussian kernel densities.

Densities are estimated as statistical packages do: values are spread over a grid
of 512 points, the binned weights are smoothed with the kernel, and densities are
read off by linear interpolation. The grid has a fixed size, so cost grows with
the rows and never with their square.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.operators.ranking import exact_quantiles
from emberlane.session import materialise

# Fixed values of the estimator: grid points, margin of the grid in bandwidths beyond
# the data, further margin while smoothing, and the density used where it is 0.
GRID = 512
CUT = 3.0
MARGIN = 4.0
FLOOR = 0.001


@dataclass
class KernelBayesModel:
    features: list[str]
    densities: DataFrame  # label, feature, low, step, density (array of GRID values)
    priors: DataFrame  # label, n

    def predict(self, queries: DataFrame, name: str = "probability") -> DataFrame:
        """Add the posterior probability of label 1. A NULL feature is left out of its row's product.

        The model is labels x features rows of fixed size; it reaches the rows as a
        scalar, so the queries are neither joined nor shuffled.
        """
        table = self.densities.agg(
            F.map_from_entries(
                F.collect_list(F.struct(F.concat_ws("|", "label", "feature"), F.struct("low", "step", "density")))
            )
        ).scalar()
        counts = self.priors.agg(F.map_from_entries(F.collect_list(F.struct("label", "n")))).scalar()
        # Step by step in named columns: one expression per value would be repeated wherever
        # the value is used and grow beyond what Spark compiles.
        pairs = [(label, feature) for label in (0, 1) for feature in self.features]
        at = {pair: F.try_element_at("_table", F.lit(f"{pair[0]}|{pair[1]}")) for pair in pairs}
        name_of = lambda step, pair: f"_{step}_{pair[0]}_{pair[1]}"
        placed = queries.withColumns({"_table": table, "_counts": counts}).withColumns(
            {name_of("place", p): _place(F.col(p[1]).cast("double"), at[p]) for p in pairs}
        )
        cut = placed.withColumns(
            {name_of("left", p): F.least(F.floor(name_of("place", p)), F.lit(GRID - 2)).cast("int") for p in pairs}
        )
        read = cut.withColumns(
            {
                name_of(side, p): F.get(at[p]["density"], F.col(name_of("left", p)) + shift)
                for p in pairs
                for side, shift in (("low", 0), ("high", 1))
            }
        )
        logs = {}
        for label in (0, 1):
            logs[f"_log{label}"] = F.ln(F.try_element_at("_counts", F.lit(label)).cast("double"))
            for p in pairs:
                if p[0] == label:
                    low, high = F.col(name_of("low", p)), F.col(name_of("high", p))
                    density = low + (high - low) * (F.col(name_of("place", p)) - F.col(name_of("left", p)))
                    # Densities are never negative, so the floor applies where one is 0.
                    density = F.when(low + high <= 0, F.lit(FLOOR)).otherwise(density)
                    logs[f"_log{label}"] += F.when(F.col(p[1]).isNull(), 0.0).otherwise(F.ln(density))
        posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_log0") - F.col("_log1")))
        seen = {label: F.try_element_at("_counts", F.lit(label)).isNotNull() for label in (0, 1)}
        # A class without training rows is never predicted.
        posterior = F.when(~seen[1], 0.0).when(~seen[0], 1.0).otherwise(posterior)
        return read.withColumns(logs).withColumn(name, posterior).select(*queries.columns, name)


def _place(value: Column, shape: Column) -> Column:
    """Position of a value on its grid; outside the grid that of the nearest end."""
    return F.least(F.greatest((value - shape["low"]) / shape["step"], F.lit(0.0)), F.lit(float(GRID - 1)))


def fit_kernel_bayes(train: DataFrame, label: str, features: Sequence[str]) -> KernelBayesModel:
    """Fit on the training rows; a NULL value is left out of its feature's density only."""
    features = list(features)
    known = train.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]
    )
    priors = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    values = known.unpivot("label", features, "feature", "x").where(F.col("x").isNotNull())
    quartiles = exact_quantiles(values, ["label", "feature"], "x", [0.25, 0.75])
    spread = quartiles.groupBy("label", "feature").agg(
        (F.max(F.when(F.col("p") == 0.75, F.col("q"))) - F.max(F.when(F.col("p") == 0.25, F.col("q")))).alias("iqr")
    )
    stats = values.groupBy("label", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd")
    )
    # Rule-of-thumb bandwidth; without spread it falls back to the deviation, then to 1.
    lean = F.least(F.coalesce("sd", F.lit(0.0)), F.col("iqr") / 1.34)
    scale = F.when(lean > 0, lean).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    shapes = materialise(
        stats.join(spread, ["label", "feature"])
        .withColumn("bw", 0.9 * scale * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .withColumn("low", F.col("lo") - CUT * F.col("bw"))
        .withColumn("high", F.col("hi") + CUT * F.col("bw"))
        .withColumn("wide_low", F.col("low") - MARGIN * F.col("bw"))
        .withColumn("wide_step", (F.col("high") - F.col("low") + 2 * MARGIN * F.col("bw")) / (GRID - 1))
        .withColumn("step", (F.col("high") - F.col("low")) / (GRID - 1)),
        "kde-shapes",
    )
    # Each value splits its weight between the two grid points beside it. The shapes are
    # labels x features rows, so broadcasting them is safe.
    place = (F.col("x") - F.col("wide_low")) / F.col("wide_step")
    cells = (
        values.join(F.broadcast(shapes.select("label", "feature", "n", "wide_low", "wide_step")), ["label", "feature"])
        .withColumn("_place", place)
        .withColumn("_left", F.floor("_place").cast("int"))
        .select(
            "label",
            "feature",
            "n",
            F.inline(
                F.array(
                    F.struct(F.col("_left").alias("cell"), (F.col("_left") + 1 - F.col("_place")).alias("w")),
                    F.struct((F.col("_left") + 1).alias("cell"), (F.col("_place") - F.col("_left")).alias("w")),
                )
            ),
        )
        .groupBy("label", "feature", "cell")
        .agg((F.sum("w") / F.first("n")).alias("w"))
    )
    grids = cells.groupBy("label", "feature").agg(F.sort_array(F.collect_list(F.struct("cell", "w"))).alias("cells"))

    def kernel_sum(j):
        gap = lambda c: (j - c["cell"]) * F.col("wide_step") / F.col("bw")
        return F.aggregate(
            "cells", F.lit(0.0), lambda total, c: total + c["w"] * F.exp(F.lit(-0.5) * gap(c) * gap(c))
        ) / (F.col("bw") * F.sqrt(2 * F.pi()))

    def regridded(j):
        spot = (F.col("low") + j * F.col("step") - F.col("wide_low")) / F.col("wide_step")
        left = F.least(F.floor(spot), F.lit(GRID - 2)).cast("int")
        low, high = F.get("smooth", left), F.get("smooth", left + 1)
        return low + (high - low) * (spot - left)

    points = F.sequence(F.lit(0), F.lit(GRID - 1))
    densities = (
        shapes.join(grids, ["label", "feature"])
        .withColumn("smooth", F.transform(points, kernel_sum))
        .withColumn("density", F.transform(points, regridded))
        .select("label", "feature", "low", "step", "density")
    )
    return KernelBayesModel(features, materialise(densities, "kde-densities"), priors)
