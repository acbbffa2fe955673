"""Top-n with ties, and exact quantiles, without sorting a table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlane.operators.joins import lookup_join
from emberlane.session import materialise


def top_n_with_ties(df: DataFrame, score: str, n: int = 10, times: str | None = None) -> DataFrame:
    """Rows with a score among the ``n`` highest, all rows tied at the last place included.

    ``times`` names a column that says how many rows each row stands for.

    The score at place n is found on distinct scores, then rows are filtered by
    it: nothing but scores is shuffled, and a tie of any size stays spread out.
    """
    highest = (
        df.where(F.col(score).isNotNull())
        .groupBy(score)
        .agg((F.sum(times) if times else F.count(F.lit(1))).alias("_n"))
        .orderBy(F.col(score).desc())
        .limit(n)
    )
    # n rows at most from here on.
    ahead = F.sum("_n").over(Window.orderBy(F.col(score).desc())) - F.col("_n")
    last = highest.withColumn("_ahead", ahead).where(F.col("_ahead") < n).agg(F.min(score))
    return df.where(F.col(score) >= last.scalar())


def sorted_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10000
) -> DataFrame:
    """Exact interpolated quantiles per group: columns ``keys``, ``p``, ``q``.

    A quantile sketch gives for each probability an interval sure to hold the
    wanted places. Values below it are only counted; the few inside are ordered.
    So no task orders a whole group, whatever the number of distinct values.
    """
    keys = list(keys)
    slack = 10.0 / accuracy
    edges = [edge for p in probs for edge in (max(p - slack, 0.0), min(p + slack, 1.0))]
    # Written, as the join below would aggregate the rows a second time to find hot groups.
    counted = materialise(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "counted-values")
    sketch = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"), F.percentile_approx(value, edges, accuracy).alias("_edges")
    )
    # A group may hold most of the rows; the join to its one sketch row spreads it.
    asked = lookup_join(counted, sketch, keys).select(
        *keys,
        value,
        "_n",
        "_total",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(float(p)).alias("p"), F.col("_edges")[2 * i].alias("lo"), F.col("_edges")[2 * i + 1].alias("hi"))
                    for i, p in enumerate(probs)
                ]
            )
        ),
    )
    inside = F.col(value).between(F.col("lo"), F.col("hi"))
    # Everything below the interval becomes one counted row, apart from the value next to it,
    # which a wanted place may just reach; above it only the next value is of use.
    zones = (
        asked.groupBy(
            *keys,
            "p",
            "_total",
            F.when(inside, F.col(value)).alias("_v"),
            F.when(inside, 0).when(F.col(value) < F.col("lo"), -1).otherwise(1).alias("_zone"),
        )
        .agg(
            F.sum("_n").alias("_n"),
            F.max(F.struct(F.col(value).alias("v"), F.col("_n").alias("n"))).alias("_last"),
            F.min(F.struct(F.col(value).alias("v"), F.col("_n").alias("n"))).alias("_first"),
        )
    )
    rest = F.struct(F.lit(None).cast("double").alias("_v"), (F.col("_n") - F.col("_last.n")).alias("_n"))
    one = lambda v, n: F.struct(F.col(v).cast("double").alias("_v"), F.col(n).alias("_n"))
    near = zones.select(
        *keys,
        "p",
        "_total",
        F.inline(
            F.when(F.col("_zone") == -1, F.array(rest, one("_last.v", "_last.n")))
            .when(F.col("_zone") == 1, F.array(one("_first.v", "_first.n")))
            .otherwise(F.array(one("_v", "_n")))
        ),
    )
    order = Window.partitionBy(*keys, "p").orderBy(F.col("_v").asc_nulls_first())
    # 0-based places: value v fills the places [upto - n, upto).
    placed = near.withColumn("_upto", F.sum("_n").over(order)).withColumn("_place", (F.col("_total") - 1) * F.col("p"))

    def value_at(place):
        here = F.col("_v").isNotNull() & (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
        return F.max(F.when(here, F.col("_v")))

    low, high = F.floor("_place"), F.ceil("_place")
    found = placed.groupBy(*keys, "p", "_place").agg(value_at(low).alias("_a"), value_at(high).alias("_b"))
    missed = F.raise_error(F.lit("quantile outside its sketched interval"))
    exact = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.floor("_place"))
    return found.select(*keys, "p", F.when(F.col("_a").isNull() | F.col("_b").isNull(), missed.cast("double")).otherwise(exact).alias("q"))
