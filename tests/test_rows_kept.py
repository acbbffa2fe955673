"""Rows that cannot be scored, ranked or told apart: kept, refused or put last, never lost silently."""

import os

import pytest
from pyspark.sql import functions as F

from emberlane import sources
from emberlane.models.evaluation import calibration
from emberlane.models.forest import fit_forest
from emberlane.models.knn import fit_knn
from emberlane.models.logistic import fit_logistic
from emberlane.models.split import split_exact
from emberlane.operators import aggregates, joins
from emberlane.plans.bin_features import bin_features, inspection_profile
from emberlane.plans.top_alarm_boxes import FACTORS, rank_boxes
from emberlane.plans.zip_features import FEATURES
from emberlane.session import clean_up, materialise, run_folder, shared_dir


def training(spark):
    rows = [(i, float(i % 7), "abc"[i % 3], int(i % 7 + i % 3 * 2 > 5) if i % 11 else 1 - int(i % 7 + i % 3 * 2 > 5)) for i in range(200)]
    return spark.createDataFrame(rows, "id int, x double, f string, y int")


@pytest.mark.parametrize("fit", [fit_logistic, fit_forest])
def test_rows_that_cannot_be_scored_stay_without_a_score(spark, fit):
    model = fit(training(spark), "y", ["x"], ["f"])
    asked = [(1, 2.0, "a"), (2, None, "a"), (3, 1.0, "new"), (4, 1.0, None), (5, float("nan"), "b"), (6, 3.0, "c")]
    got = {r.id: r.probability for r in model.score(spark.createDataFrame(asked, "id int, x double, f string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert [got[i] is None for i in range(1, 7)] == [False, True, True, True, True, False]


def test_a_logistic_model_says_what_it_left_out_and_whether_it_converged(spark):
    train = training(spark).withColumn("same", F.lit("s"))
    model = fit_logistic(train, "y", ["x"], ["f", "same"])
    assert model.constant == ["same"] and model.converged
    assert not fit_logistic(train, "y", ["x"], ["f"], max_iter=1).converged


def test_heavy_weights_do_not_push_the_iterations_off(spark):
    rows = spark.createDataFrame([(g, y) for g, n in (("a", 7000), ("b", 5000)) for y in [1] * (n // 10) + [0] * n], "g string, y int")
    terms = {r.term: r.estimate for r in fit_logistic(rows, "y", [], ["g"]).coefficients(spark).collect()}
    assert abs(terms["(Intercept)"] + 2.302585) < 1e-4 and abs(terms["g_b"]) < 1e-4


def test_many_levels_fit_into_a_forest(spark):
    rows = spark.createDataFrame([(f"l{i % 60}", i % 2) for i in range(600)], "f string, y int")
    assert fit_forest(rows, "y", [], ["f"], trees=3).score(rows).filter("probability is null").count() == 0


def test_scores_outside_the_unit_interval_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0.5), (0, 1.5)], "k int, s double")
    with pytest.raises(Exception, match="outside"):
        calibration(rows, "k", "s", 1).collect()


def test_null_keys_are_refused_by_the_split(spark):
    rows = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    with pytest.raises(Exception, match="NULL"):
        split_exact(rows, "k").collect()


def test_null_ordinals_come_last_and_ties_leave_one_row(spark):
    rows = spark.createDataFrame(
        [(1, None, "n"), (1, 5, "b"), (2, None, "only"), (3, 1, "z"), (3, 1, "y"), (None, 2, "null key")], "k int, o int, v string"
    )
    kept = joins.keep_first(rows, "k", "o")
    assert {(r.k, r.v) for r in kept.collect()} == {(1, "b"), (2, "only"), (3, "y"), (None, "null key")}
    plan = joins.keep_first(rows, "k", "o")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "partial_min" in plan
    joined = joins.keep_first_join(spark.createDataFrame([(2,), (9,)], "k int"), rows, "k", "o").collect()
    assert {(r.k, r.v) for r in joined} == {(2, "only"), (9, None)}


def test_first_rows_of_several_tables_side_by_side(spark):
    a = spark.createDataFrame([(1, 5, "a5", None), (1, 3, "a3", "x"), (None, 1, "null key", "y"), (2, None, "only", "z")], "k long, o int, p string, q string")
    b = spark.createDataFrame([(1, 9.0, 7), (3, 2.0, 8), (3, 2.0, 6), (4, None, None)], "k long, o double, r int")
    got = joins.first_rows_side_by_side([(a, ["p", "q"]), (b, ["r"])], "k", "o")
    assert got.columns == ["k", "p", "q", "r"]
    wanted = {(1, "a3", "x", 7), (None, "null key", "y", None), (2, "only", "z", None), (3, None, None, 6), (4, None, None, None)}
    assert set(map(tuple, got.collect())) == wanted
    assert joins.first_rows_side_by_side([(a.limit(0), ["p"]), (b.limit(0), ["r"])], "k", "o").count() == 0


def test_nearest_neighbours_treat_nan_as_missing_both_ways(spark):
    train = spark.createDataFrame([(i, float(i % 9), float(i % 5), i % 2) for i in range(120)], "id int, a double, b double, y int")
    asked = spark.createDataFrame([(1, 1.0, 2.0), (2, float("nan"), 2.0), (3, None, 1.0), (4, 7.5, 0.0)], "id int, a double, b double")
    answers = []
    for pivots in (1024, 10):
        model = fit_knn(train, "id", "y", ["a", "b"], max_pivots=pivots)
        answers.append({r.id: r.prediction for r in model.predict(asked).collect()})
    assert answers[0] == answers[1] and answers[0][2] is None and answers[0][3] is None and answers[0][1] is not None


def test_half_of_all_rows_on_one_key_are_joined_in_one_scan(spark):
    fact = spark.range(4000).withColumn("k", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")))
    lookup = spark.range(0, 4000, 3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {r.id: r.v for r in joins.lookup_join(fact, lookup, "k").collect()}
    assert len(got) == 4000 and got[1] is None and got[3] == 6 and got[2] is None
    focused = joins.focus_on(fact, lookup, "k")
    assert focused.count() == fact.filter("k % 3 = 0").count() and focused.columns == ["id", "k"]


def test_columns_are_bound_by_the_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text('B,A,C\n1,"x\ny",2.5\n,NA,oops\n7,"say ""hi""",\n')
    read = sources.read_csv_null(spark, str(tmp_path / "t.csv"), "A string, B int, C double", multi_line=True)
    assert sorted(map(tuple, read.collect()), key=str) == sorted([("x\ny", 1, 2.5), (None, None, None), ('say "hi"', 7, None)], key=str)
    with pytest.raises(ValueError, match="no column D"):
        sources.read_csv_null(spark, str(tmp_path / "t.csv"), "A string, D int")
    (tmp_path / "bad.csv").write_text("A,B\n1,2\n3\n")
    with pytest.raises(Exception):  # noqa: B017
        sources.read_csv_null(spark, str(tmp_path / "bad.csv"), "A string, B int", strict=True).collect()


def test_all_input_tables_are_read_with_their_schemas(spark, tmp_path):
    from pyspark.sql.types import StructType

    for name, ddl in sources.SCHEMAS.items():
        columns = StructType.fromDDL(ddl).names
        (tmp_path / f"{name}.csv").write_text(",".join(reversed(columns)) + "\n" + ",".join("7" for _ in columns) + "\n")
    tables = sources.read_tables(spark, str(tmp_path))
    assert set(tables) == set(sources.SCHEMAS)
    assert all(t.count() == 1 and t.columns == StructType.fromDDL(sources.SCHEMAS[n]).names for n, t in tables.items())


def test_building_rows_by_summary(spark):
    inspections = spark.createDataFrame([(1, "H1", "APPROVAL"), (1, "H2", None), (2, None, "X")], "BIN long, ALPHA string, LAST_INSP_STAT string")
    fitness = spark.createDataFrame([], "BIN long, COF_TYPE string, EXPIRES_ON string")
    summary = spark.createDataFrame(
        [(1, "1;2", "s", None, "p", 1, 2), (1, "9", "t", "1", "q", None, 0), (None, "1", "n", "1", "n", 1, 1)],
        "BIN long, NUM_SIAM_SPRINKLER string, SPRINKLER_TYPE string, NUM_SIAM_STANDPIPE string, STANDPIPE_TYPE string, "
        "NUM_OF_VIOLATION_NOTICES int, NUM_OF_VIOLATION_ORDER int",
    )
    sizes = {}
    for name, options in {"once": {}, "pairs": {"pair_summaries": True}, "one": {"one_row_per_bin": True}}.items():
        rows = bin_features(inspections, fitness, summary, **options).collect()
        sizes[name] = sorted(r.BIN for r in rows)
    assert sizes == {"once": [1, 1, 2], "pairs": [1, 1, 1, 1, 2], "one": [1, 2]}
    with pytest.raises(ValueError, match="more than 1"):
        inspection_profile(inspections, max_levels=1)


def test_boxes_are_ranked_by_given_scores(spark):
    rows = [(k, 100 + k % 2, f"{k % 3}", *("a",) * len(FACTORS), *(float(k % 4),) * len(FEATURES)) for k in range(24)]
    names = ["STARFIRE_INCIDENT_ID", "ZIPCODE", "ALARM_BOX_NUMBER", *FACTORS, *FEATURES]
    incidents = spark.createDataFrame(rows, names)
    score = lambda df: df.withColumn("link", F.col(FEATURES[0]) - F.col("ZIPCODE") % 2)
    linked = sorted((r[-1] - r[1] % 2, r[1], r[2]) for r in rows)
    for n in (1, 7, 30):
        cut = sorted((x[0] for x in linked), reverse=True)[min(n, len(linked)) - 1]
        wanted = sorted((z, b) for s, z, b in linked if s >= cut)
        assert sorted(map(tuple, rank_boxes(incidents, score, n).collect())) == wanted
    per_box = rank_boxes(incidents, score, 2, per_box=True).collect()
    best = {}
    for s, z, b in linked:
        best[z, b] = max(s, best.get((z, b), s))
    cut = sorted(best.values(), reverse=True)[1]
    assert sorted(map(tuple, per_box)) == sorted(k for k, s in best.items() if s >= cut)


def test_approximate_medians_lie_close(spark):
    rows = spark.range(2001).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    got = {r.g: r.m for r in aggregates.approx_median_by(rows, ["g"], F.col("x"), "m").collect()}
    assert abs(got[0] - 1000) <= 2 and abs(got[1] - 999) <= 2


def test_intermediate_tables_lie_in_one_folder_that_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("emberlane.session.shared_dir", lambda _: str(tmp_path))
    materialise(spark.range(3), "x")
    assert os.path.isdir(run_folder(spark)) and run_folder(spark).startswith(str(tmp_path))
    clean_up(spark)
    assert not os.path.exists(run_folder(spark)) and tmp_path.exists()


def test_a_local_session_without_a_shared_folder_gets_one(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    assert os.path.isdir(shared_dir(spark)) and shared_dir(spark) == shared_dir(spark)
