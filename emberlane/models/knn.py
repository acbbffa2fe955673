"""Exact k-nearest-neighbour classification as a distributed join.

Training points are assigned to the nearest of a bounded set of pivots, taken
from the training points themselves. For a query, the triangle inequality gives
for every pivot's cell a least possible distance, so only cells that can hold one
of the k nearest are joined. Inside a cell a tree over its points leaves out those
that are too far away. No neighbour is left out and no product is formed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.functions.constants import NEIGHBOURS
from emberlane.operators.joins import lookup_join
from emberlane.session import materialise

MAX_PIVOTS = 1024
# Points and queries of a cell joined as one group; larger cells are cut into lanes both ways.
LANE_ROWS = 10_000
# Points in a leaf of a cell's tree, and queries that go down the tree together.
LEAF_ROWS = 32
CHUNK = 2000


def _squared(features: Sequence[str], other, own=F.col) -> Column:
    """Squared Euclidean distance, added up in the order of ``features``."""
    total = None
    for f in features:
        gap = own(f) - other(f)
        total = gap * gap if total is None else total + gap * gap
    return total


@dataclass
class Cells:
    """At most max_pivots cells: pivot positions, least and greatest distance of a member, lanes (0: empty)."""

    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    lanes: np.ndarray

    def distances(self, at: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots, added up feature by feature as in ``_squared``."""
        total = np.zeros((len(at), len(self.pivots)))
        for i in range(at.shape[1]):
            gap = at[:, i, None] - self.pivots[None, :, i]
            total += gap * gap
        return np.sqrt(total)


def _slack(distance: np.ndarray) -> np.ndarray:
    """Keeps rounding of distances from ruling out a cell or point that ties."""
    return 1e-9 * (1.0 + np.abs(distance))


def _chunks(batches, size: int = 1000):
    for batch in batches:
        for start in range(0, len(batch), size):
            yield batch.iloc[start : start + size]


def _pivot_bound(distances: np.ndarray, k: int) -> np.ndarray:
    """Pivots are training points: the k-th nearest pivot bounds the k-th neighbour."""
    if distances.shape[1] < k:
        return np.full(len(distances), np.inf)
    return np.partition(distances, k - 1, axis=1)[:, k - 1]


def _visit_schema(features: Sequence[str]) -> str:
    return ", ".join([*[f"`{f}` double" for f in features], "_bound double", "_cell int"])


def _assigned(cells: Cells, features: list[str]):
    """Add the nearest pivot and the distance to it."""

    def assign(batches):
        for batch in _chunks(batches):
            to = cells.distances(batch[features].to_numpy(float))
            cell = to.argmin(axis=1)
            yield batch.assign(_cell=cell.astype(np.int32), _radius=to[np.arange(len(to)), cell])

    return assign


def _home_visits(cells: Cells, features: list[str], k: int):
    """One visit per query: the cell of its nearest pivot."""

    def visit(batches):
        for batch in _chunks(batches):
            to = cells.distances(batch[features].to_numpy(float))
            home = to.argmin(axis=1)
            d = to[np.arange(len(to)), home]
            yield batch[features].assign(_bound=_pivot_bound(to, k) + _slack(d), _cell=home.astype(np.int32))

    return visit


def _other_visits(cells: Cells, features: list[str], k: int):
    """Visits to all other cells that can hold a point within the bound."""

    def visit(batches):
        for batch in _chunks(batches):
            to = cells.distances(batch[features].to_numpy(float))
            nearest = to.min(axis=1)
            bound = np.fmin(batch["_kth"].to_numpy(float), _pivot_bound(to, k))
            limit = bound[:, None] + _slack(to)
            least = np.maximum(np.maximum(to - cells.far, cells.near - to), (to - nearest[:, None]) / 2)
            open_cells = (least <= limit) & (cells.lanes > 0)
            open_cells[np.arange(len(to)), to.argmin(axis=1)] = False
            row, cell = np.nonzero(open_cells)
            found = batch[features].iloc[row].reset_index(drop=True)
            yield found.assign(_bound=limit[row, cell], _cell=cell.astype(np.int32))

    return visit


class Tree:
    """Points of one group, halved at the median of their widest feature until a leaf holds ``LEAF_ROWS`` of them.

    ``at`` holds a row per point, in the order that settles equal distances.
    """

    def __init__(self, at: np.ndarray):
        n, width = at.shape
        self.depth = max(0, math.ceil(math.log2(max(1, n) / LEAF_ROWS)))
        leaves = 1 << self.depth
        ends = np.arange(leaves + 1) * n // leaves
        order = np.arange(n)
        for level in range(self.depth):
            step = leaves >> level
            for start in range(0, leaves, step):
                low, middle, high = ends[start], ends[start + step // 2], ends[start + step]
                inside = at[order[low:high]]
                widest = inside[:, (inside.max(axis=0) - inside.min(axis=0)).argmax()]
                order[low:high] = order[low:high][np.argpartition(widest, middle - low)]
        # Leaves are filled up to one length with points at no distance that counts, numbered after all others.
        place = ends[:-1, None] + np.arange(np.diff(ends).max())
        filled = place < ends[1:, None]
        self.rows = np.where(filled, order[np.minimum(place, n - 1)], n)
        self.at = np.where(filled[:, :, None], at[np.minimum(self.rows, n - 1)], np.inf)
        low = self.at.min(axis=1)
        high = np.where(filled[:, :, None], self.at, -np.inf).max(axis=1)
        # Boxes of the nodes of each depth, the root's first.
        self.boxes = [(low, high)]
        for _ in range(self.depth):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.boxes.insert(0, (low, high))
        self.size = n
        self.compared = 0

    def _to_box(self, at: np.ndarray, depth: int, node: np.ndarray) -> np.ndarray:
        """Squared distances to boxes, never above those to the points inside."""
        low, high = self.boxes[depth]
        gaps = np.maximum(np.maximum(low[node] - at, at - high[node]), 0.0)
        return (gaps * gaps).sum(axis=1) * (1 - 1e-9)

    def nearest(self, asked: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and rows of the k nearest points no farther than ``bound``; rows past the last one are ``size``."""
        d2 = np.full((len(asked), k), np.inf)
        rows = np.full((len(asked), k), self.size)
        limit = bound * bound * (1 + 1e-9)
        # The leaf a query comes to by the nearer half each time tightens its bound before others are looked for.
        leaf = np.zeros(len(asked), dtype=np.int64)
        for depth in range(1, self.depth + 1):
            right = self._to_box(asked, depth, 2 * leaf + 1) < self._to_box(asked, depth, 2 * leaf)
            leaf = 2 * leaf + right
        every = np.arange(len(asked))
        self._look(asked, every, leaf, limit, d2, rows)
        query, node = every, np.zeros(len(asked), dtype=np.int64)
        least = np.zeros(len(asked))
        for depth in range(1, self.depth + 1):
            query, node = np.repeat(query, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
            least = self._to_box(asked[query], depth, node)
            near = least <= limit[query]
            query, node, least = query[near], node[near], least[near]
        near = node != leaf[query]
        query, node, least = query[near], node[near], least[near]
        order = np.lexsort((least, query))
        query, node, least = query[order], node[order], least[order]
        # The nearest other leaf of every query, then the second nearest of those that still need one, ...
        while len(query):
            first = np.r_[True, query[1:] != query[:-1]]
            self._look(asked, query[first], node[first], limit, d2, rows)
            near = ~first & (least <= limit[query])
            query, node, least = query[near], node[near], least[near]
        return d2, rows

    def _look(self, asked: np.ndarray, query: np.ndarray, leaf: np.ndarray, limit: np.ndarray, d2: np.ndarray, rows: np.ndarray) -> None:
        """Put the points of one leaf for each of the queries named among their nearest."""
        k = d2.shape[1]
        at = self.at[leaf]
        found = np.zeros(at.shape[:2])
        # Added up feature by feature as in ``_squared``.
        for i in range(asked.shape[1]):
            gap = asked[query, None, i] - at[:, :, i]
            found += gap * gap
        self.compared += found.size
        mine = found <= limit[query, None]
        all_d2 = np.concatenate([d2[query], np.where(mine, found, np.inf)], axis=1)
        all_rows = np.concatenate([rows[query], np.where(mine, self.rows[leaf], self.size)], axis=1)
        best = np.lexsort((all_rows, all_d2), axis=1)[:, :k]
        d2[query] = np.take_along_axis(all_d2, best, axis=1)
        rows[query] = np.take_along_axis(all_rows, best, axis=1)
        limit[query] = np.minimum(limit[query], d2[query, -1] * (1 + 1e-9))


def _searched(features: list[str], k: int, schema: pa.Schema):
    """The k nearest points of every query of a group, both as Arrow tables."""

    def search(asked: pa.Table, points: pa.Table) -> pa.Table:
        if not asked.num_rows or not points.num_rows:
            return schema.empty_table()
        points = points.take(pc.sort_indices(points, sort_keys=[("_id", "ascending")]))
        tree = Tree(np.column_stack([points["_p_" + f].to_numpy() for f in features]))
        where = np.column_stack([asked[f].to_numpy() for f in features])
        bound = asked["_bound"].to_numpy()
        found = [tree.nearest(where[i : i + CHUNK], bound[i : i + CHUNK], k) for i in range(0, len(where), CHUNK)]
        d2, rows = (np.concatenate(x) for x in zip(*found, strict=True))
        query, rank = np.nonzero(rows < tree.size)
        near = points.select(["_id", "label"]).take(pa.array(rows[query, rank]))
        columns = [*(pa.array(where[query, i]) for i in range(len(features))), near["_id"], near["label"], pa.array(d2[query, rank])]
        return pa.table(columns, schema=schema)

    return search


@dataclass
class KnnModel:
    features: list[str]
    k: int
    scales: dict[str, tuple[float, float]]
    inline: Column | None = None  # all points as an array of structs, for a small training set
    points: DataFrame | None = None  # otherwise _id, label, features, _cell, _radius, _lane
    cells: Cells | None = None

    def predict(self, queries: DataFrame, name: str = "prediction") -> DataFrame:
        """``queries`` with the majority label of the k nearest training points.

        Equal distances are ordered by training id, equal votes by label. Rows with
        a NULL or NaN feature get no prediction. Equal queries are answered once.
        """
        if self.points is None:
            return self._predict_inline(queries, name)
        asked = _numeric(queries, self.features, self.scales)
        distinct = asked.na.drop("any").groupBy(*self.features).agg(F.lit(1).alias("_one")).drop("_one")
        votes = self.neighbours(distinct).groupBy(*self.features).agg(F.mode("label", True).alias(name))
        keyed = queries.withColumns({"_k_" + f: _scaled(f, self.scales) for f in self.features})
        answers = votes.withColumnsRenamed({f: "_k_" + f for f in self.features})
        return lookup_join(keyed, answers, ["_k_" + f for f in self.features]).drop(*["_k_" + f for f in self.features])

    def _predict_inline(self, queries: DataFrame, name: str) -> DataFrame:
        known = F.lit(True)
        for f in self.features:
            known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
        points = F.transform(
            "_pivots",
            lambda p: F.struct(
                _squared(self.features, lambda f: p[f], lambda f: _scaled(f, self.scales)).alias("d2"), p["_id"], p["label"]
            ),
        )
        labels = F.transform(F.slice(F.array_sort(points), 1, self.k), lambda p: p["label"])
        votes = F.transform(
            F.array_distinct("_labels"),
            lambda v: F.struct((-F.size(F.filter("_labels", lambda x: x == v))).alias("against"), v.alias("label")),
        )
        answered = queries.withColumn("_pivots", self.inline).withColumn("_labels", labels)
        return answered.withColumn(name, F.when(known, F.array_min(votes)["label"])).select(*queries.columns, name)

    def neighbours(self, queries: DataFrame) -> DataFrame:
        """The k nearest training points of each distinct feature vector."""
        f = self.features
        home = _home_visits(self.cells, f, self.k)
        first = self._nearest(queries.select(*f).mapInPandas(home, _visit_schema(f)))
        # The home cell's k-th distance tightens the bound before other cells are considered.
        bounded = materialise(
            first.groupBy(*f).agg(
                F.when(F.count(F.lit(1)) >= self.k, F.sqrt(F.max("_d2"))).alias("_kth"),
                F.collect_list(F.struct("_id", "label", "_d2")).alias("_found"),
            ),
            "knn-bounds",
        )
        other = _other_visits(self.cells, f, self.k)
        others = self._nearest(bounded.select(*f, "_kth").mapInPandas(other, _visit_schema(f)))
        known = bounded.select(*f, F.inline("_found"))
        return self._closest(known.unionByName(others.select(known.columns)))

    def _nearest(self, asked: DataFrame) -> DataFrame:
        """The k closest points of each query among the cells it visits."""
        f = self.features
        visits = materialise(asked, "knn-visits")
        # A cell that many queries visit is cut by queries too. One row per cell is broadcast.
        crowds = F.broadcast(
            visits.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / LANE_ROWS).cast("int").alias("_crowds"))
        )
        lanes = F.sequence(F.lit(0), F.element_at(F.lit(self.cells.lanes.tolist()), F.col("_cell") + 1) - 1)
        asking = (
            visits.join(crowds, "_cell")
            .withColumn("_crowd", F.pmod(F.xxhash64(*f), F.col("_crowds").cast("long")).cast("int"))
            .withColumn("_lane", F.explode(lanes))
            .drop("_crowds")
        )
        points = self.points.withColumnsRenamed({name: "_p_" + name for name in f}).join(crowds, "_cell")
        answering = points.withColumn("_crowd", F.explode(F.sequence(F.lit(0), F.col("_crowds") - 1))).drop("_crowds")
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = T.StructType(
            [*[T.StructField(name, T.DoubleType()) for name in f], self.points.schema["_id"], self.points.schema["label"], T.StructField("_d2", T.DoubleType())]
        )
        group = ["_cell", "_lane", "_crowd"]
        search = _searched(f, self.k, to_arrow_schema(schema))
        pairs = asking.select(*f, "_bound", *group).groupBy(*group)
        found = pairs.cogroup(answering.select(*["_p_" + name for name in f], "_id", "label", *group).groupBy(*group))
        return self._closest(found.applyInArrow(search, schema))

    def _closest(self, scored: DataFrame) -> DataFrame:
        order = Window.partitionBy(*self.features).orderBy("_d2", "_id")
        return scored.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= self.k).drop("_rank")


def _scaled(feature: str, scales: dict) -> Column:
    # Adding 0.0 turns -0.0 into 0.0, so that equal values have equal join keys.
    value = F.col(feature).cast("double") + F.lit(0.0)
    if feature in scales:
        mean, spread = scales[feature]
        value = (value - F.lit(mean)) / F.lit(spread)
    return value


def _numeric(df: DataFrame, features: Sequence[str], scales: dict) -> DataFrame:
    return df.select(*[_scaled(f, scales).alias(f) for f in features])


def fit_knn(
    train: DataFrame,
    key: str,
    label: str,
    features: Sequence[str],
    k: int = NEIGHBOURS,
    scale: bool = False,
    max_pivots: int = MAX_PIVOTS,
) -> KnnModel:
    """Index the training rows without NULLs or NaNs. ``scale`` standardises the features first.

    Up to ``max_pivots`` points travel with every task as one array, beyond that they are put into
    cells; both ways are exact and give the same answers. ``max_pivots`` also bounds the cells, whose number
    grows with the square root of the points: give more where a cell would hold too many points.
    """
    features = list(features)
    scales = {}
    if scale:
        stats = train.agg(
            *[F.avg(F.col(f).cast("double")).alias("m_" + f) for f in features],
            *[F.stddev_samp(F.col(f).cast("double")).alias("s_" + f) for f in features],
        ).first()
        scales = {f: (stats["m_" + f], stats["s_" + f] or 1.0) for f in features}
    rows = train.select(
        F.col(key).alias("_id"), F.col(label).alias("label"), *[_scaled(f, scales).alias(f) for f in features]
    ).na.drop("any")
    # Of points at the same place only the k with the smallest ids can be among the k nearest
    # of any query, so further copies are dropped; each task does so before the shuffle.
    copies = Window.partitionBy(*features).orderBy("_id")
    rows = rows.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")
    rows = materialise(rows, "knn-points")
    size = rows.count()
    wanted = size if size <= max_pivots else min(max_pivots, max(k, math.isqrt(size)))
    chosen = rows.withColumn("_h", F.md5(F.col("_id").cast("string"))).orderBy("_h", "_id").limit(wanted)
    if wanted == size:
        everything = chosen.agg(F.sort_array(F.collect_list(F.struct("_h", "_id", "label", *features)))).scalar()
        return KnnModel(features, k, scales, inline=everything)
    # At most max_pivots pivots, and as many cells, come to the driver and go out with the tasks.
    pivots = np.array([[r[f] for f in features] for r in chosen.collect()], dtype=float)
    blank = np.zeros(len(pivots))
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_radius", T.DoubleType())]
    )
    assigned = materialise(rows.mapInPandas(_assigned(Cells(pivots, blank, blank, blank), features), schema), "knn-cells")
    sizes = assigned.groupBy("_cell").agg(
        F.ceil(F.count(F.lit(1)) / LANE_ROWS).cast("int").alias("lanes"),
        F.min("_radius").alias("near"),
        F.max("_radius").alias("far"),
    )
    cells = Cells(pivots, blank.copy(), blank.copy(), blank.astype(int))
    for r in sizes.collect():
        cells.near[r["_cell"]], cells.far[r["_cell"]], cells.lanes[r["_cell"]] = r["near"], r["far"], r["lanes"]
    lane = F.pmod(F.xxhash64("_id", *features), F.element_at(F.lit(cells.lanes.tolist()), F.col("_cell") + 1).cast("long"))
    return KnnModel(features, k, scales, points=assigned.withColumn("_lane", lane.cast("int")), cells=cells)
