"""Seeded exact-size split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.functions.constants import SEED

LABELS = ("train", "validate", "test")
FRACTIONS = (0.50, 0.25)


def split_hash(key: str, seed: int = SEED) -> Column:
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.coalesce(hashed, F.raise_error(F.lit(f"{key} holds NULL, rows cannot be told apart by it")).cast("string"))


def split_exact(
    df: DataFrame,
    key: str,
    fractions: Sequence[float] = FRACTIONS,
    sizes: Sequence[int] | None = None,
    seed: int = SEED,
    name: str = "split",
) -> DataFrame:
    """Add a column with train / validate / test of exact sizes (fractions are rounded up).

    Rows are taken in the order of a hash of their unique key, so the parts do not
    depend on partitioning. Each part ends at the hash of its last row; those two
    hashes are found by counting hash prefixes and ordering only the rows that
    share the prefix in question. The rows themselves are never sorted or shuffled:
    they are compared with the two hashes, which are found right away, so ``df``
    should be a table and not a long computation. A NULL key is an error.
    """
    hashed = df.select(split_hash(key, seed).alias("_h")).withColumn("_prefix", F.substring("_h", 1, 4))
    if sizes is None:
        total = F.sum("_n").over(Window.partitionBy())
        first = F.ceil(total * fractions[0])
        ends = [first, first + F.ceil(total * fractions[1])]
    else:
        ends = [F.lit(sizes[0]), F.lit(sizes[0] + sizes[1])]
    # At most 16^4 prefixes, so these windows are small.
    prefixes = (
        hashed.groupBy("_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_ends", F.array(*[F.struct(F.lit(i).alias("part"), e.cast("long").alias("end")) for i, e in enumerate(ends)]))
        .withColumn("_before", F.sum("_n").over(Window.orderBy("_prefix")) - F.col("_n"))
        .select("_prefix", "_n", "_before", F.inline("_ends"))
    )
    cuts = prefixes.where((F.col("_before") < F.col("end")) & (F.col("end") <= F.col("_before") + F.col("_n")))
    place = F.row_number().over(Window.partitionBy("part").orderBy("_h"))
    # Two cut rows at most are broadcast.
    last = (
        hashed.join(F.broadcast(cuts.select("_prefix", "part", (F.col("end") - F.col("_before")).alias("_take"))), "_prefix")
        .withColumn("_place", place)
        .where(F.col("_place") == F.col("_take"))
        .agg(F.struct(*[F.max(F.when(F.col("part") == i, F.col("_h"))).alias(f"h{i}") for i in (0, 1)]))
        .first()[0]
    )
    # An empty part ends where the one before it does.
    train_end = last["h0"] or ""
    validate_end = last["h1"] or train_end
    here = split_hash(key, seed)
    return df.withColumn(
        name, F.when(here <= train_end, LABELS[0]).when(here <= validate_end, LABELS[1]).otherwise(LABELS[2])
    )


def split_by_hash(df: DataFrame, key: str, fractions: Sequence[float] = FRACTIONS, seed: int = SEED, name: str = "split") -> DataFrame:
    """Split by hash range in one pass, no counting: sizes are only close to the fractions."""
    share = F.conv(F.substring(split_hash(key, seed), 1, 8), 16, 10).cast("double") / float(16**8)
    return df.withColumn(
        name,
        F.when(share < fractions[0], LABELS[0]).when(share < fractions[0] + fractions[1], LABELS[1]).otherwise(LABELS[2]),
    )
