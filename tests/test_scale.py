"""The operators written for scale against brute force on small skewed data, and their plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.functions.constants import SEED
from emberlane.models import evaluation, kde_bayes, knn, odds, split
from emberlane.models.logistic import fit_logistic
from emberlane.operators import joins, ranking
from emberlane.plans.partition_by_year import one_year
from emberlane.sources import read_year, write_by_year
from emberlane.session import scratch_path


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows of which a third have key 7 and some a NULL key."""
    key = "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 400 END"
    return spark.range(3000).selectExpr("id", f"CAST({key} AS INT) AS k")


def test_hot_keys_are_found(spark, skewed):
    (hot,) = joins.hot_keys(skewed, "k")
    seven = spark.range(1).select(F.xxhash64(F.lit(7))).first()[0]
    assert seven in hot and len(hot) <= joins.HOT_KEYS


@pytest.mark.parametrize("mode", ["found", "none", "wrong"])
def test_lookup_join_is_exact_whatever_is_hot(spark, skewed, mode):
    lookup = spark.range(300).selectExpr("CAST(id AS INT) AS k", "concat('v', id) AS v").union(
        spark.sql("SELECT CAST(NULL AS INT), 'null'")
    )
    hot = {"found": None, "none": [], "wrong": [1, 2, 3]}[mode]
    got = {r.id: r.v for r in joins.lookup_join(skewed, lookup, "k", hot).collect()}
    rows = skewed.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.id] == ("null" if r.k is None else f"v{r.k}" if r.k < 300 else None)


def test_lookup_join_spreads_a_hot_key(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        lookup = spark.range(400).selectExpr("CAST(id AS INT) AS k", "id AS v")
        joined = joins.lookup_join(skewed, lookup, "k")
        sizes = joined.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
        plain = joins.lookup_join(skewed, lookup, "k", []).where("k = 7").groupBy(F.spark_partition_id()).count().collect()
        assert len(plain) == 1 and len(sizes) >= 12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {
        "flat": rng.normal(size=5001),
        "few": np.array([3.0, 1.0]),
        "one": np.array([2.0]),
        "hot": np.concatenate([np.full(900, 5.0), rng.normal(size=600)]),
        "four": np.array([4.0, 1.0, 3.0, 2.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r.g, r.p): r.q for r in ranking.exact_quantiles(df, ["g"], "x", probs).collect()}
    for g, vs in groups.items():
        for p in probs:
            assert got[g, p] == pytest.approx(float(np.quantile(vs, p)), abs=1e-12)


def test_split_is_exact_and_complete(spark):
    df = spark.range(217).toDF("k")
    divided = split.split_exact(df, "k")
    counts = {r.split: r["count"] for r in divided.groupBy("split").count().collect()}
    assert counts == {"train": 109, "validate": 55, "test": 53}
    again = split.split_exact(df.repartition(7), "k")
    assert divided.exceptAll(again).count() == 0 and divided.count() == 217
    sized = split.split_exact(df, "k", sizes=(10, 5)).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in sized} == {"train": 10, "validate": 5, "test": 202}
    other = split.split_exact(df, "k", seed=SEED + 1)
    assert divided.exceptAll(other).count() > 0


def test_split_by_hash_is_close(spark):
    parts = split.split_by_hash(spark.range(4000).toDF("k"), "k").groupBy("split").count().collect()
    share = {r.split: r["count"] / 4000 for r in parts}
    assert share["train"] == pytest.approx(0.5, abs=0.05) and share["validate"] == pytest.approx(0.25, abs=0.05)


def brute_auc(scores, truths):
    pos = [s for s, t in zip(scores, truths) if t == 1]
    neg = [s for s, t in zip(scores, truths) if t == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_is_exact(spark):
    rng = np.random.default_rng(5)
    scores = [float(round(s, 2)) for s in rng.random(400)] + [0.5] * 200
    truths = [int(rng.random() < 0.2 + 0.5 * s) for s in scores]
    df = spark.createDataFrame(list(zip(scores, truths)), "s double, t int")
    for buckets in (4, 256):
        assert evaluation.auc(df, "s", "t", buckets).first().auc == pytest.approx(brute_auc(scores, truths), abs=1e-12)
    assert evaluation.auc(df.where("t = 1"), "s", "t").first().auc is None


def test_auc_of_hard_labels_is_mean_of_recall_and_specificity(spark):
    rows = [(1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (1, 1)]
    df = spark.createDataFrame(rows, "p int, t int")
    row = evaluation.model_row(df, "m", "p", "t").first()
    assert row.auc == pytest.approx(evaluation.auc(df, "p", "t").first().auc)


def brute_knn(train, queries, k):
    answers = {}
    for key, q in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, v)), i, y) for i, y, v in train)[:k]
        votes = [y for _, _, y in near]
        answers[key] = max(sorted(set(votes)), key=votes.count)
    return answers


@pytest.mark.parametrize("max_pivots", [8, 1024])
def test_knn_equals_brute_force_on_clustered_copies(spark, max_pivots):
    rng = np.random.default_rng(11)
    # A third of the points are copies of one place, a third lie in one tight cluster.
    points = [(1.0, 1.0)] * 100 + [tuple(5 + 0.01 * rng.normal(size=2)) for _ in range(100)]
    points += [tuple(10 * rng.random(2)) for _ in range(100)]
    train = [(i, int(rng.random() < 0.5), tuple(map(float, p))) for i, p in enumerate(points)]
    queries = [(1000 + i, tuple(map(float, p))) for i, p in enumerate([(1.0, 1.0)] * 30 + [tuple(12 * rng.random(2)) for _ in range(60)])]
    tdf = spark.createDataFrame([(i, y, *v) for i, y, v in train], "id int, y int, a double, b double")
    qdf = spark.createDataFrame([(i, *v) for i, v in queries] + [(1, None, 2.0)], "id int, a double, b double")
    model = knn.fit_knn(tdf, "id", "y", ["a", "b"], k=5, max_pivots=max_pivots)
    assert (model.points is None) == (max_pivots == 1024)
    got = {r.id: r.prediction for r in model.predict(qdf).collect()}
    assert got.pop(1) is None
    assert got == brute_knn(train, queries, 5)


def test_knn_lanes_cut_large_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "LANE_ROWS", 10)
    rng = np.random.default_rng(2)
    train = [(i, i % 2, (float(a), float(b))) for i, (a, b) in enumerate(rng.random((200, 2)))]
    queries = [(i, (float(a), float(b))) for i, (a, b) in enumerate(rng.random((40, 2)))]
    tdf = spark.createDataFrame([(i, y, *v) for i, y, v in train], "id int, y int, a double, b double")
    qdf = spark.createDataFrame([(i, *v) for i, v in queries], "id int, a double, b double")
    model = knn.fit_knn(tdf, "id", "y", ["a", "b"], k=3, max_pivots=4)
    assert model.points.agg(F.max("_lane")).first()[0] > 0
    assert {r.id: r.prediction for r in model.predict(qdf).collect()} == brute_knn(train, queries, 3)


def test_tree_finds_the_nearest_rows_without_comparing_all():
    rng = np.random.default_rng(7)
    # Places on a grid: many equal distances, which the order of the rows settles.
    places = lambda n: np.column_stack([rng.poisson(6, n), rng.poisson(6, n), rng.integers(0, 300, n) / 1024]).astype(float)
    at, asked = places(6000), places(300)
    every = sum((asked[:, None, i] - at[None, :, i]) ** 2 for i in range(3))
    for bound in (np.full(300, np.inf), 2 * rng.random(300)):
        tree = knn.Tree(at)
        d2, rows = tree.nearest(asked, bound, 5)
        for q in range(300):
            near = [i for i in np.lexsort((np.arange(6000), every[q]))[:5] if every[q, i] <= bound[q] ** 2]
            assert rows[q][rows[q] < 6000].tolist() == near
            assert d2[q][: len(near)].tolist() == every[q, near].tolist()
        assert tree.compared < 300 * 6000 / 20
    for n in (1, 2, 33):
        assert sorted(knn.Tree(at[:n]).nearest(asked[:1], np.array([np.inf]), 40)[1][0].tolist())[:n] == list(range(n))


def test_knn_orders_equal_distances_by_text_ids(spark):
    train = [(f"p{(7 * i) % 400}", i % 3, (float(i % 20), float(i // 20))) for i in range(400)]
    queries = [(i, (i % 19 + 0.5, i // 19 + 0.5)) for i in range(60)]
    tdf = spark.createDataFrame([(i, y, *v) for i, y, v in train], "id string, y int, a double, b double")
    qdf = spark.createDataFrame([(i, *v) for i, v in queries], "id int, a double, b double")
    model = knn.fit_knn(tdf, "id", "y", ["a", "b"], k=3, max_pivots=4)
    found = model.neighbours(qdf.select("a", "b")).groupBy("a", "b").agg(F.sort_array(F.collect_list("_id")).alias("ids"))
    near = lambda v: sorted(i for _, i in sorted((sum((x - y) ** 2 for x, y in zip(v, p)), i) for i, _, p in train)[:3])
    assert {(r.a, r.b): r.ids for r in found.collect()} == {v: near(v) for _, v in queries}


def test_knn_scaling_changes_the_metric(spark):
    tdf = spark.createDataFrame([(1, 0, 0.0, 1000.0), (2, 1, 1.0, 0.0), (3, 1, 1.0, 10.0)], "id int, y int, a double, b double")
    qdf = spark.createDataFrame([(9, 0.0, 450.0)], "id int, a double, b double")
    assert knn.fit_knn(tdf, "id", "y", ["a", "b"], k=1).predict(qdf).first().prediction == 1
    assert knn.fit_knn(tdf, "id", "y", ["a", "b"], k=1, scale=True).predict(qdf).first().prediction == 0


def test_kernel_bayes_close_to_exact_densities(spark):
    rng = np.random.default_rng(8)
    rows = [(int(y), float(rng.normal(y * 2)), float(rng.exponential() + y)) for y in [0, 1] * 150]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    model = kde_bayes.fit_kernel_bayes(df, "y", ["a", "b"])
    queries = [(0.0, 0.5), (2.0, 1.5), (1.0, 1.2)]
    got = [r.p for r in model.predict(spark.createDataFrame(queries, "a double, b double"), "p").collect()]

    def density(values, x):
        v = np.array(values)
        spread = min(v.std(ddof=1), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34)
        bw = 0.9 * spread * len(v) ** -0.2
        return float(np.mean(np.exp(-0.5 * ((x - v) / bw) ** 2) / (bw * math.sqrt(2 * math.pi))))

    for (a, b), p in zip(queries, got):
        score = {
            y: density([r[1] for r in rows if r[0] == y], a) * density([r[2] for r in rows if r[0] == y], b) for y in (0, 1)
        }
        assert p == pytest.approx(score[1] / (score[0] + score[1]), abs=5e-3)


def test_kernel_bayes_without_spread(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 3.0), (1, 3.0)], "y int, a double")
    model = kde_bayes.fit_kernel_bayes(df, "y", ["a"])
    near = [r.probability for r in model.predict(spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double")).collect()]
    assert near[0] < 0.5 < near[1] and near[2] == pytest.approx(0.5)


def test_kernel_bayes_with_one_class(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "y int, a double")
    model = kde_bayes.fit_kernel_bayes(df, "y", ["a"])
    assert model.predict(spark.createDataFrame([(1.5,)], "a double")).first().probability == 1.0


def test_odds_equal_the_fitted_model(spark):
    rows = [(g, y) for g, n1, n0 in [("A", 5, 15), ("B", 9, 11), ("C", 2, 8)] for y in [1] * n1 + [0] * n0]
    df = spark.createDataFrame(rows, "g string, y int")
    closed = {r.term: r.estimate for r in odds.odds_by_group(df, "y", "g").collect()}
    fitted = {r.term.replace("_", ""): r.estimate for r in fit_logistic(df, "y", [], ["g"]).coefficients(spark).collect()}
    assert closed.keys() == fitted.keys()
    assert all(closed[t] == pytest.approx(fitted[t], abs=1e-8) for t in closed)
    overall = odds.odds_overall(df, "y").first()
    assert overall.odds == pytest.approx(16 / 34)


def test_merged_rows_give_the_same_logistic_fit(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.random() < 0.3 + 0.1 * (i % 4)), float(i % 4), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "y int, x double, g string")
    weight = F.when(F.col("y") == 1, 2.0).otherwise(1.0)
    model = fit_logistic(df, "y", ["x"], ["g"], weight)
    beta = {r.term: r.estimate for r in model.coefficients(spark).collect()}
    # The score equations hold at the maximum of the weighted likelihood of the single rows.
    link = lambda x, g: beta["(Intercept)"] + beta["x"] * x + (beta["g_b"] if g == "b" else 0.0)
    gap = [(2.0 if y else 1.0) * (y - 1 / (1 + math.exp(-link(x, g)))) for y, x, g in rows]
    assert abs(sum(gap)) < 1e-6 and abs(sum(r * x for r, (_, x, _) in zip(gap, rows))) < 1e-6


def test_year_table_is_pruned(spark):
    path = scratch_path(spark, "test-years")
    write_by_year(spark.range(100).selectExpr("id", "CASE WHEN id < 90 THEN CAST(2019 + id % 3 AS INT) END AS year"), path)
    one = read_year(spark, path, 2020)
    assert one.count() == 30 and "PartitionFilters: [isnotnull(year" in plan(one)
    assert read_year(spark, path, None).count() == 10


def test_large_year_is_written_by_several_tasks(spark):
    path = scratch_path(spark, "test-years")
    df = spark.range(200_000).selectExpr("id", "CAST(2021 AS INT) AS year", "sha2(string(id), 256) AS pad")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(2 * 1024 * 1024))
    try:
        write_by_year(df.repartition(8), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(set(r[0] for r in read_year(spark, path, 2021).select(F.input_file_name()).distinct().collect())) > 1


def test_one_year_job(spark):
    df = spark.createDataFrame([(1, "1/5/2021 9:03:04 PM"), (2, "12/31/2020 1:00:00 AM"), (3, "bad")], "id int, INCIDENT_DATETIME string")
    assert [r.id for r in one_year(df, scratch_path(spark, "test-years"), 2021).collect()] == [1]
