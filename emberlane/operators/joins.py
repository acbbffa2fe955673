"""Joins: NULL keys that match, first match only, natural keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.session import materialise

# lookup_join: at most this many keys count as hot, those with more than this share of the
# rows, and each is spread over at least this many lanes.
HOT_KEYS = 64
HOT_SHARE = 1 / 1000
LANES = 64


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _null_safe(keys: Sequence[str], prefix: str) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def left_join_nullsafe(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Left join in which a NULL key matches a NULL key."""
    keys = _names(keys)
    tagged = right.withColumnsRenamed({k: "_r_" + k for k in keys})
    return left.join(tagged, _null_safe(keys, "_r_"), "left").drop(*["_r_" + k for k in keys])


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: bool = True) -> DataFrame:
    """Left join on all common columns; every match is kept.

    ``null_safe=False`` is for a left side without NULL keys: plain equality gives
    the same rows and keeps the left side's partitioning for the next join.
    """
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("the tables have no column in common")
    return left_join_nullsafe(left, right, keys) if null_safe else left.join(right, keys, "left")


def keep_first(df: DataFrame, keys: str | Sequence[str], ordinal: str) -> DataFrame:
    """One row per key, the one with the smallest ordinal, NULL values included.

    NULL ordinals come last: such a row is taken only if its key has no other. Of rows with
    equal key and ordinal the first by their values is taken. The table is read once, and an
    aggregate keeps one row per key in each task before the shuffle, so neither a hot key nor
    rows that tie in large numbers meet in one task.
    """
    keys = _names(keys)
    rest = [c for c in df.columns if c not in keys and c != ordinal]
    first = df.groupBy(*keys).agg(F.min(_place(ordinal, rest)).alias("_first"))
    return first.select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def _place(ordinal: str, columns: Sequence[str]) -> Column:
    """What rows are ordered by: the ordinal, NULL last, then the values that go with it."""
    return F.struct(F.col(ordinal).isNull().alias("_missing"), F.col(ordinal).alias("_ordinal"), *columns)


def first_rows_side_by_side(sources: Sequence[tuple[DataFrame, Sequence[str]]], key: str, ordinal: str) -> DataFrame:
    """One row per key with the first row's columns of each source, NULL where a source lacks the key.

    ``sources``: tables that have ``key``, ``ordinal`` and the columns named, which differ between sources. They are
    reduced together, in one shuffle, and whoever needs them all joins them once.
    """
    tagged = [table.select(key, _place(ordinal, columns).alias(f"_row{i}")) for i, (table, columns) in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = rows.groupBy(key).agg(*[F.min(f"_row{i}").alias(f"_row{i}") for i in range(len(sources))])
    return first.select(key, *[F.col(f"_row{i}")[c].alias(c) for i, (_, columns) in enumerate(sources) for c in columns])


def hot_keys(fact: DataFrame, *key_sets: str | Sequence[str]) -> list[list[int]]:
    """Hashes of the keys that hold a large share of the rows, per set of key columns.

    One pass over the key columns with a sketch of fixed size per task; nothing is
    shuffled, and at most HOT_KEYS hashes per set come back to the driver.
    """
    hashes = [F.xxhash64(*_names(keys)).alias(f"_h{i}") for i, keys in enumerate(key_sets)]
    sketches = [F.expr(f"approx_top_k(_h{i}, {HOT_KEYS}, {HOT_KEYS * 64})").alias(f"_h{i}") for i in range(len(key_sets))]
    row = fact.select(*hashes).agg(F.count(F.lit(1)).alias("_n"), *sketches).first()
    return [[top["item"] for top in row[f"_h{i}"] or [] if top["count"] > row["_n"] * HOT_SHARE] for i in range(len(key_sets))]


def _broadcasts(table: DataFrame) -> bool:
    """Whether Spark will broadcast a written table for its size."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def lookup_join(
    fact: DataFrame, lookup: DataFrame, keys: str | Sequence[str], hot: Sequence[int] | None = None
) -> DataFrame:
    """Null-safe left join of a large table to a lookup with at most one row per key.

    The lookup is written once, so its size is known. If Spark will broadcast it, nothing else
    is needed. Otherwise hot keys are looked for in one pass over the fact's keys: their
    rows are spread over lanes, and the few lookup rows of hot keys are repeated once per lane, so no task
    gets all rows of one key. There are as many lanes as shuffle partitions, which grow with
    the data. ``hot`` comes from ``hot_keys`` when the caller has it already; it decides where rows
    are joined, never what they are joined to.
    """
    keys = _names(keys)
    values = [c for c in lookup.columns if c not in keys]
    lookup = materialise(lookup, "lookup")
    if hot is None:
        hot = [] if _broadcasts(lookup) else hot_keys(fact, keys)[0]
    if not hot:
        return left_join_nullsafe(fact, lookup, keys).select(*fact.columns, *values)
    lane_count = max(LANES, int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    is_hot = F.xxhash64(*keys).isin(list(hot))
    # The partition id keeps copies of one row apart; it is the same when a task is run again.
    lane = F.pmod(F.xxhash64(F.spark_partition_id(), *fact.columns), F.lit(lane_count)).cast("int")
    spread = fact.withColumn("_lane", F.when(is_hot, lane).otherwise(0))
    lanes = F.when(is_hot, F.sequence(F.lit(0), F.lit(lane_count - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.withColumn("_r_lane", F.explode(lanes)).withColumnsRenamed({k: "_r_" + k for k in keys})
    same = _null_safe(keys, "_r_") & (F.col("_lane") == F.col("_r_lane"))
    return spread.join(repeated, same, "left").select(*fact.columns, *values)


def keep_first_join(
    left: DataFrame, right: DataFrame, keys: str | Sequence[str], ordinal: str, hot: Sequence[int] | None = None
) -> DataFrame:
    """Left join to the first matching row only: the result has the rows of ``left``.

    A column both sides have keeps the left side's values.
    """
    keys = _names(keys)
    new = [c for c in right.columns if c not in left.columns or c in keys or c == ordinal]
    return lookup_join(left, keep_first(right.select(*new), keys, ordinal), keys, hot)


def focus_on(df: DataFrame, focus: DataFrame, key: str) -> DataFrame:
    """Keep the rows whose key is in ``focus``; a NULL key never is.

    The distinct keys are written, so that Spark knows their size: it broadcasts them, or joins two plain
    shuffles, of which adaptive execution splits a hot key.
    """
    wanted = materialise(focus.select(key).where(F.col(key).isNotNull()).distinct(), "focus-keys")
    return df.join(wanted, key, "left_semi").select(*df.columns)
