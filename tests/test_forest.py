"""Forests: what each tree draws, how it is grown, and what it says, against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.functions.constants import SEED
from emberlane.models import forest


def plain_tree(x, y, n, tree, weights, number=1, depth=0, max_depth=30):
    """The same tree node by node."""
    n0, n1 = int(n[y == 0].sum()), int(n[y == 1].sum())
    best = None
    if n0 and n1 and n0 + n1 > forest.SMALLEST_SPLIT and depth < max_depth:
        order = sorted(range(x.shape[1]), key=lambda f: hashlib.md5(f"{SEED}:{tree}:{number}:{f}".encode()).hexdigest())
        score = lambda side: sum(w * float(n[side & (y == k)].sum()) ** 2 for k, w in enumerate(weights)) / float(n[side].sum())
        for f in sorted(order[: max(1, int(x.shape[1] ** 0.5))]):
            values = sorted(set(x[:, f]))
            for a, b in zip(values, values[1:]):
                left = x[:, f] <= a
                found = score(left) + score(~left)
                if best is None or found > best[0]:
                    best = (found, f, (a + b) / 2 if (a + b) / 2 < b else a)
    if best is None:
        return [(number, None, None, n0, n1)]
    _, f, cut = best
    nodes = [(number, f, float(cut), n0, n1)]
    for side, child in ((x[:, f] <= cut, 2 * number), (x[:, f] > cut, 2 * number + 1)):
        nodes += plain_tree(x[side], y[side], n[side], tree, weights, child, depth + 1, max_depth)
    return nodes


@pytest.mark.parametrize("weights", [(1.0, 1.0), (1.0, 10.0)])
def test_trees_equal_growing_node_by_node(weights):
    draw = np.random.default_rng(7)
    for tree in range(12):
        rows = int(draw.integers(1, 300))
        x = np.stack([draw.integers(0, 9, rows), draw.normal(size=rows).round(1), draw.integers(0, 2, rows), np.zeros(rows), draw.normal(size=rows)], axis=1)
        y = (x[:, 0] + draw.normal(size=rows) > 5).astype(int)
        n = draw.integers(1, 4, rows)
        for depth in (30, 3, 0):
            got = forest.grow_tree(x, y, n, tree, weights, depth, SEED)
            assert sorted(got, key=lambda r: r[0]) == sorted(plain_tree(x, y, n, tree, weights, max_depth=depth), key=lambda r: r[0])


def rows(spark, n=900):
    columns = "id bigint, a double, f string, y int"
    return spark.createDataFrame([(k, float(k % 13), "abcd"[k % 4], int(k % 13 > 9 or k % 29 == 0)) for k in range(n)], columns)


def test_half_of_each_trees_sample_is_from_either_class_and_partitions_do_not_matter(spark):
    table = rows(spark)
    models = [forest.fit_forest(t, "y", ["a"], ["f"], (1.0, 10.0), balanced=True, trees=4, key="id") for t in (table, table.repartition(7, "f"))]
    drawn = {(r.tree, r.outcome): r.n for r in models[0].draws.groupBy("tree", "outcome").agg(F.sum("n").alias("n")).collect()}
    assert drawn == {(t, y): 450 for t in range(4) for y in (0, 1)}
    nodes = [sorted(map(tuple, m.trees.collect()), key=repr) for m in models]
    assert nodes[0] == nodes[1] and len({n[0] for n in nodes[0]}) == 4
    scores = [{r.id: r.probability for r in m.score(table).collect()} for m in models]
    assert scores[0] == scores[1]
    # Walked by hand.
    trees = {}
    for tree, node, feature, cut, n0, n1 in nodes[0]:
        trees.setdefault(tree, {})[node] = (feature, cut, n1 / (n0 + n1))
    for r in table.limit(60).collect():
        shares = []
        for tree in trees.values():
            at, x = 1, (r.a, "abcd".index(r.f) + 1.0)
            while tree[at][0] is not None:
                at = 2 * at + (x[tree[at][0]] > tree[at][1])
            shares.append(tree[at][2])
        assert scores[0][r.id] == pytest.approx(sum(shares) / len(shares), abs=1e-12)


def test_draws_are_bounded_with_replacement_and_cover_all_rows(spark):
    model = forest.fit_forest(rows(spark), "y", ["a"], [], trees=20, key="id", rows_per_tree=300)
    drawn = model.draws.groupBy("tree").agg(F.sum("n").alias("n"), F.count("row").alias("different")).collect()
    assert {r.n for r in drawn} == {300} and all(200 < r.different < 300 for r in drawn)
    assert model.draws.select("row").distinct().count() > 880 and model.draws.agg(F.min("row"), F.max("row")).first()[0] >= 0


def test_one_class_no_rows_and_missing_values(spark):
    table = rows(spark, 60)
    only = forest.fit_forest(table.withColumn("y", F.lit(1)), "y", ["a"], ["f"], balanced=True, trees=2, key="id")
    assert {r.probability for r in only.score(table).collect()} == {1.0}
    none = forest.fit_forest(table.limit(0), "y", ["a"], ["f"], trees=2, key="id")
    assert none.trees.count() == 0 and {r.probability for r in none.score(table).collect()} == {None}
    holes = table.withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")))
    model = forest.fit_forest(holes, "y", ["a"], [], trees=2, key="id")
    assert model.draws.groupBy("tree").agg(F.sum("n").alias("n")).first().n == 30
    assert {r.id for r in model.score(holes).collect() if r.probability is None} == set(range(1, 60, 2))
