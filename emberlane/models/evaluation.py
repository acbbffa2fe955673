"""Confusion counts, metrics, exact AUC and calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlane.session import materialise

AUC_BUCKETS = 256
RANGE_SCORES = 200_000


def confusion(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    """tn, fp, fn, tp in one pass; rows with a NULL on either side do not count."""
    cell = lambda p, t: F.count_if((F.col(prediction) == p) & (F.col(truth) == t))
    return df.agg(cell(0, 0).alias("tn"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(1, 1).alias("tp"))


def metrics(df: DataFrame, prediction: str, truth: str) -> DataFrame:
    """Confusion counts with accuracy, precision and recall; an empty denominator gives NULL."""
    counts = confusion(df, prediction, truth)
    return counts.select(
        "tn",
        "fp",
        "fn",
        "tp",
        F.try_divide(F.expr("tn + tp"), F.expr("tn + fp + fn + tp")).alias("accuracy"),
        F.try_divide("tp", F.expr("tp + fp")).alias("precision"),
        F.try_divide("tp", F.expr("tp + fn")).alias("recall"),
    )


def auc(df: DataFrame, score: str, truth: str, buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL if a class is missing.

    There are at least 256 ranges, and more where one would hold over RANGE_SCORES distinct scores.

    Rows are first counted per distinct score. Distinct scores are cut into ranges
    of about equal size; pairs within a range come from a window over that range,
    pairs across ranges from the range totals. No task sees all scores, and the scored
    rows, which may be costly to compute, are read once.
    """
    per_score = materialise(
        df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(F.col(score).cast("double").alias("s"))
        .agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")),
        "auc-scores",
    )
    buckets = buckets or max(AUC_BUCKETS, per_score.count() // RANGE_SCORES)
    cuts = per_score.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 10 * buckets)).scalar()
    ranged = per_score.withColumn("_cuts", F.array_distinct(cuts)).withColumn(
        "bucket", F.size(F.filter("_cuts", lambda cut: cut <= F.col("s")))
    )
    below = F.sum("neg").over(Window.partitionBy("bucket").orderBy("s")) - F.col("neg")
    per_range = (
        ranged.withColumn("inner", F.col("pos") * (below + F.col("neg") / 2))
        .groupBy("bucket")
        .agg(F.sum("inner").alias("inner"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # One row per range, ``buckets`` at most: far fewer than scores.
    before = F.sum("neg").over(Window.orderBy("bucket")) - F.col("neg")
    won = per_range.withColumn("won", F.col("inner") + F.col("pos").cast("double") * before)
    return won.agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def calibration(df: DataFrame, klass: str, score: str, event, bins: int = 10) -> DataFrame:
    """Observed share of ``event`` per score bin: ``bins`` equal bins of [0, 1], closed on the right.

    Every bin is listed; the share of an empty one is NULL. A score outside [0, 1] is an error.
    Rows with a NULL class or score do not count.
    """
    value = F.col(score).cast("double")
    outside = F.raise_error(F.lit(f"{score} lies outside [0, 1]")).cast("double")
    value = F.when(value.between(0, 1), value).otherwise(outside)
    binned = df.where(F.col(klass).isNotNull() & F.col(score).isNotNull()).select(
        F.greatest(F.lit(1), F.ceil(value * bins).cast("int")).alias("bin"),
        (F.col(klass) == F.lit(event)).alias("_hit"),
    )
    counted = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("events"))
    all_bins = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counted, "bin", "left").select(
        "bin",
        ((F.col("bin") - 0.5) / bins).alias("midpoint"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("events", F.lit(0)).alias("events"),
        F.try_divide("events", "n").alias("share"),
    )


def model_row(df: DataFrame, name: str, prediction: str, truth: str) -> DataFrame:
    """One comparison row: the metrics and the AUC of the hard predictions.

    On hard predictions the AUC is the mean of recall and specificity.
    """
    return metrics(df, prediction, truth).select(
        F.lit(name).alias("model"),
        "*",
        ((F.col("recall") + F.try_divide("tn", F.expr("tn + fp"))) / 2).alias("auc"),
    )


def compare(rows: list[DataFrame]) -> DataFrame:
    """Model rows together, the best by AUC flagged."""
    table = reduce(DataFrame.unionByName, rows)
    # One row per model, so a window over all of them is small.
    return table.withColumn("best", F.col("model") == F.max_by("model", "auc").over(Window.partitionBy()))
