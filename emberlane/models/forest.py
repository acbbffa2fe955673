"""Probability forests: drawn samples as a join, one task for each tree, trees as a table.

Spark ML draws every tree from all rows alike and keeps its draws to itself. Here each tree has a sample of its own, half of it from
either class if asked, and everything that decides a tree (which rows were drawn, which features a node may use) follows from
hashes, so the same rows give the same trees whatever the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.functions.constants import SEED, TREES
from emberlane.models.logistic import factor_levels, score_all_rows
from emberlane.models.split import split_hash
from emberlane.session import materialise

#: Rows drawn for one tree at most: what a task holds, and with it the size of a tree.
ROWS_PER_TREE = 100_000
#: A node of so many drawn rows or fewer is not split.
SMALLEST_SPLIT = 10
_NODES = "tree int, node bigint, feature int, cut double, n0 bigint, n1 bigint"


@dataclass
class ForestModel:
    #: One row per node: tree, node (1 is the root, 2k and 2k + 1 are k's parts), feature (place in ``columns``, NULL in a leaf),
    #: cut (up to it rows go to 2k), n0 and n1 (drawn rows of either class).
    trees: DataFrame
    #: What each tree was grown on: tree, outcome, row (its number among the rows it was drawn from), n (how often it was drawn).
    draws: DataFrame
    columns: list[str]
    levels: dict[str, list[str]]

    def score(self, df: DataFrame) -> DataFrame:
        """All rows with ``probability`` of outcome 1, the mean over all trees of the share of 1 in the row's leaf.

        A NULL (or NaN) feature, or a level the training rows lack, gives NULL. The trees travel to every task: at most
        ``rows_per_tree`` leaves each, so their size depends on the model's settings and not on the rows.
        """
        walk = _walk(self.trees.toPandas())
        inputs = [_as_number(c, self.levels) for c in self.columns]
        return score_all_rows(df, lambda rows: rows.withColumn("probability", walk(*inputs)), self.columns, self.levels, ["probability"])


def _as_number(column: str, levels: dict[str, list[str]]) -> Column:
    """A factor is the place of its level in alphabetical order."""
    if column not in levels:
        return F.col(column).cast("double")
    return F.array_position(F.array(*[F.lit(v) for v in levels[column]]), F.col(column).cast("string")).cast("double")


def _walk(nodes: pd.DataFrame):
    """A column function that walks all trees with a batch of rows at a time."""
    trees = []
    for _, tree in nodes.sort_values("node").groupby("tree"):
        number = tree["node"].to_numpy()
        inner = tree["feature"].notna().to_numpy()
        left = np.searchsorted(number, np.where(inner, 2 * number, number))
        trees.append(
            (
                tree["feature"].fillna(0).to_numpy().astype(np.int32),
                tree["cut"].fillna(0.0).to_numpy(),
                left.astype(np.int32),
                inner,
                (tree["n1"] / (tree["n0"] + tree["n1"])).to_numpy(),
            )
        )

    @F.pandas_udf("double")
    def probability(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in columns:
            # One feature alone comes without a tuple around it.
            x = np.stack([c.to_numpy(dtype=np.float64) for c in (batch if isinstance(batch, tuple) else (batch,))], axis=1)
            total = np.zeros(len(x))
            for feature, cut, left, inner, share in trees:
                at = np.zeros(len(x), dtype=np.int32)
                moving = np.arange(len(x)) if inner[0] else np.empty(0, dtype=np.int64)
                while len(moving):
                    here = at[moving]
                    at[moving] = left[here] + (x[moving, feature[here]] > cut[here])
                    moving = moving[inner[at[moving]]]
                total += share[at]
            yield pd.Series(total / len(trees)) if trees else pd.Series([None] * len(x), dtype=object)

    return probability


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row``: from 0, gapless within a stratum, in the order of ``_hash``.

    Hash prefixes are counted first, so that a window sees the rows of one prefix and not those of a stratum.
    """
    prefixed = rows.withColumn("_prefix", F.substring("_hash", 1, 4))
    counted = prefixed.groupBy("_stratum", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16^4 prefixes for either stratum.
    starts = counted.withColumn("_before", F.sum("_n").over(Window.partitionBy("_stratum").orderBy("_prefix")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_stratum", "_prefix").orderBy("_hash"))
    placed = prefixed.withColumn("_place", place).join(F.broadcast(starts), ["_stratum", "_prefix"])
    return placed.withColumn("row", F.col("_before") + F.col("_place") - 1).drop("_prefix", "_place", "_before", "_hash")


def drawn_rows(spark, strata: dict[int, tuple[int, int]], trees: int, seed: int) -> DataFrame:
    """(tree, stratum, row, n): for each tree and stratum so many draws with replacement; ``strata``: (rows, draws) of each.

    Draw j of a tree takes the row at its stratum's size times the hash of (seed, tree, stratum, j) as a number below 1.
    """
    parts = None
    for stratum, (size, draws) in sorted(strata.items()):
        if not size or not draws:
            continue
        numbers = spark.range(trees * draws).select(F.floor(F.col("id") / draws).cast("int").alias("tree"), (F.col("id") % draws).alias("j"))
        hashed = F.md5(F.concat_ws(":", F.lit(seed), F.col("tree"), F.lit(stratum), F.col("j")))
        share = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
        picked = numbers.select("tree", F.lit(stratum).alias("_stratum"), F.floor(share * F.lit(float(size))).alias("row"))
        parts = picked if parts is None else parts.unionByName(picked)
    if parts is None:
        parts = spark.createDataFrame([], "tree int, _stratum int, row bigint")
    return parts.groupBy("tree", "_stratum", "row").agg(F.count(F.lit(1)).alias("n"))


def _cut(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle = (low + high) / 2
    return np.where(middle < high, middle, low)


def grow_tree(
    x: np.ndarray, y: np.ndarray, n: np.ndarray, tree: int, weights: tuple[float, float], max_depth: int, seed: int
) -> list[tuple[int, int | None, float | None, int, int]]:
    """(node, feature, cut, n0, n1) of every node of a tree grown on rows ``x`` with outcomes ``y``, each drawn ``n`` times.

    A node may use the square root of the number of features, those whose hash with seed, tree and node is smallest. It takes the
    cut with the largest sum over both parts of the weighted squared class counts over the part's size; of equally good ones
    the first feature's smallest cut. A node without two classes or two values is a leaf. All nodes of a depth are split at once.
    """
    features = x.shape[1]
    tried = max(1, int(features**0.5))
    values, codes = zip(*[np.unique(x[:, f], return_inverse=True) for f in range(features)], strict=True)
    counts = np.stack([np.where(y == 0, n, 0), np.where(y == 1, n, 0)], axis=1).astype(np.float64)
    rows, node, numbers, found = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), [1], []
    for depth in range(max_depth + 1):
        both = np.stack([np.bincount(node, counts[rows, k], len(numbers)) for k in (0, 1)], axis=1)
        open_ = (both.sum(axis=1) > SMALLEST_SPLIT) & (both > 0).all(axis=1) & (depth < max_depth)
        may_use = np.zeros((len(numbers), features), dtype=bool)
        for k in np.flatnonzero(open_):
            order = sorted(range(features), key=lambda f: hashlib.md5(f"{seed}:{tree}:{numbers[k]}:{f}".encode()).digest())
            may_use[k, order[:tried]] = True
        best, feature, cut = np.full(len(numbers), -1.0), np.full(len(numbers), -1), np.zeros(len(numbers))
        for f in range(features):
            inside = np.flatnonzero(may_use[node, f])
            if not len(inside):
                continue
            cells, back = np.unique(node[inside] * len(values[f]) + codes[f][rows[inside]], return_inverse=True)
            own, code = cells // len(values[f]), cells % len(values[f])
            here = np.stack([np.bincount(back, counts[rows[inside], k], len(cells)) for k in (0, 1)], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums = np.cumsum(here, axis=0)
            before = np.concatenate([[[0.0, 0.0]], sums])[starts][np.searchsorted(starts, np.arange(len(cells)), side="right") - 1]
            low = sums - before
            high = both[own] - low
            gap = np.flatnonzero(np.concatenate([own[1:] == own[:-1], [False]]))  # a cut lies after this cell
            if not len(gap):
                continue
            score = lambda part: (weights[0] * part[:, 0] * part[:, 0] + weights[1] * part[:, 1] * part[:, 1]) / (part[:, 0] + part[:, 1])
            scores = score(low[gap]) + score(high[gap])
            # Of each node the first cut with the best score.
            order = np.lexsort((gap, -scores, own[gap]))
            first = order[np.concatenate([[True], own[gap][order][1:] != own[gap][order][:-1]])]
            better = first[scores[first] > best[own[gap[first]]]]
            at = gap[better]
            best[own[at]], feature[own[at]] = scores[better], f
            cut[own[at]] = _cut(values[f][code[at]], values[f][code[at + 1]])
        split = feature >= 0
        found += [
            (number, int(f) if s else None, float(c) if s else None, int(a), int(b))
            for number, s, f, c, (a, b) in zip(numbers, split, feature, cut, both, strict=True)
        ]
        if not split.any():
            break
        places = 2 * (np.cumsum(split) - 1)
        numbers = [part for number, s in zip(numbers, split, strict=True) if s for part in (2 * number, 2 * number + 1)]
        going = split[node]
        rows, node = rows[going], node[going]
        node = places[node] + (x[rows, feature[node]] > cut[node])
    return found


def fit_forest(
    train: DataFrame,
    outcome: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    class_weights: tuple[float, float] | None = None,
    balanced: bool = False,
    trees: int = TREES,
    max_depth: int = 30,
    seed: int = SEED,
    key: str | None = None,
    rows_per_tree: int = ROWS_PER_TREE,
) -> ForestModel:
    """Fit a forest for a 0/1 outcome on the training rows without NULLs.

    Every tree is grown on draws with replacement, as many as there are rows but ``rows_per_tree`` at most: from all rows, or with
    ``balanced`` half of them from either class. ``class_weights`` (of outcome 0 and 1) count in the choice of cuts; a leaf's probability is
    the share among its drawn rows. Factors are cut in alphabetical order of their levels.

    ``key`` names a column that tells rows apart and so decides the draws; without it they depend on how rows are partitioned. A
    class without rows is not drawn; without any rows there are no trees and every probability is NULL.
    """
    columns = [*numeric, *categorical]
    used = train.select(F.col(outcome).cast("int").alias("_outcome"), *columns, *([F.col(key).alias("_key")] if key and key not in columns else []))
    used = used.withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.col(c).cast("string") for c in categorical})
    used = used.na.drop("any", subset=["_outcome", *columns])
    levels = factor_levels(used, categorical)
    if key:
        order = split_hash("_key" if key not in columns else key, seed)
    else:
        order = F.md5(F.concat_ws(":", F.to_json(F.struct("_outcome", *columns)), F.monotonically_increasing_id()))
    stratum = F.col("_outcome") if balanced else F.lit(0)
    numbers = [_as_number(c, levels).alias(f"_x{i}") for i, c in enumerate(columns)]
    rows = materialise(used.select("_outcome", *numbers, order.alias("_hash"), stratum.alias("_stratum")), "forest-rows")
    sizes = {r["_stratum"]: r["n"] for r in rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = min(sum(sizes.values()), rows_per_tree)
    strata = {s: (size, total // 2 if balanced else total) for s, size in sizes.items()}
    weights = tuple(float(w) for w in class_weights or (1.0, 1.0))

    picked = drawn_rows(train.sparkSession, strata, trees, seed).join(_numbered(rows), ["_stratum", "row"])
    picked = materialise(picked.withColumnRenamed("_outcome", "outcome"), "forest-draws")

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        x = np.stack([sample[f"_x{i}"].to_numpy() for i in range(len(columns))], axis=1)
        nodes = grow_tree(x, sample["outcome"].to_numpy(), sample["n"].to_numpy(), tree, weights, max_depth, seed)
        table = pd.DataFrame(nodes, columns=["node", "feature", "cut", "n0", "n1"])
        return table.assign(tree=tree, feature=table["feature"].astype("Int32"))[["tree", "node", "feature", "cut", "n0", "n1"]]

    grown = materialise(picked.groupBy("tree").applyInPandas(grow, _NODES), "forest-trees")
    return ForestModel(grown, picked.select("tree", "outcome", "row", "n"), columns, levels)
