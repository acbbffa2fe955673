"""Hand-made edge rows for functions and operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberlane.functions import dates, logic, text
from emberlane.models import evaluation, logistic
from emberlane.operators import aggregates, columns, filters, joins, ranking


def values(df):
    return [tuple(r) for r in df.collect()]


def one_column(spark, items, kind="string"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")


def applied(spark, items, expression, kind="string"):
    return [r[0] for r in one_column(spark, items, kind).orderBy("i").select(expression(F.col("x"))).collect()]


def test_pad_box(spark):
    boxes = [None, "", "7", "42", "123", "1234", "12345"]
    assert applied(spark, boxes, text.pad_box) == [None, None, "0007", "0042", "0123", "1234", None]
    assert applied(spark, boxes, text.pad_box_keep) == [None, "", "0007", "0042", "0123", "1234", "12345"]


def test_drop_first_char_and_key(spark):
    assert applied(spark, ["B0012", "X", "", None], text.drop_first_char) == ["0012", "", "", None]
    assert applied(spark, ["0012", "x1", None], text.box_key) == [12, None, None]


def test_split_sum(spark):
    assert applied(spark, ["1;2;x", "", None, "2.5; 1", "NaN;4"], text.split_sum) == [3.0, 0.0, None, 3.5, 4.0]


def test_dates(spark):
    parsed = applied(spark, ["1/5/2021", "01/05/2021", "junk", None, "13/1/2021"], dates.parse_mdy)
    assert parsed == [dt.date(2021, 1, 5), dt.date(2021, 1, 5), None, None, None]
    texts = ["1/5/2021 9:03:04 PM", "01/05/2021 12:03:04 AM", "1/5/2021 12:00:00 PM", "junk", None]
    hours = applied(spark, texts, lambda x: F.date_format(dates.parse_mdy_hms(x), "HH:mm:ss"))
    assert hours == ["21:03:04", "00:03:04", "12:00:00", None, None]
    assert applied(spark, texts[:1], lambda x: dates.weekday_name(dates.parse_mdy_hms(x))) == ["Tuesday"]
    assert applied(spark, texts[:1], lambda x: dates.month_name(dates.parse_mdy_hms(x))) == ["January"]
    after = applied(spark, ["12/31/2020", "1/1/2021", None], lambda x: dates.year_after(dates.parse_mdy(x), 2020))
    assert after == [False, True, None]


def test_labels_differ_on_unclassified(spark):
    kinds = ["Alarm System - Defective", "Alarm System - Unnecessary", "Medical", None]
    assert applied(spark, kinds, logic.false_alarm) == [1, 1, 0, None]
    assert applied(spark, kinds, logic.false_alarm_or_zero) == [1, 1, 0, 0]
    assert applied(spark, kinds, logic.collapse_false_alarms) == ["1", "1", "0", None]


def test_threshold_is_strict(spark):
    assert applied(spark, [0.7, 0.7000001, 0.1, None], logic.above, "double") == [0, 1, 0, None]


def test_recode_whole_cells_of_text_columns_only(spark):
    df = spark.createDataFrame([("MN", 1, "MNX"), (None, 2, "QN")], "a string, b int, c string")
    assert values(logic.recode_boroughs(df).orderBy("b")) == [("Manhattan", 1, "MNX"), (None, 2, "Queens")]


def test_corrected_borough(spark):
    rows = [("", "21 WEST END AVE"), ("BX", "21 WEST END AVE"), ("", "1 ELSEWHERE"), ("", None), (None, "21 WEST END AVE")]
    df = spark.createDataFrame(rows, "b string, a string")
    fixed = df.select(logic.corrected_borough(F.col("b"), F.col("a")))
    assert [r[0] for r in fixed.collect()] == ["Manhattan", "BX", "", "", None]


def test_null_keys_match(spark):
    left = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    expected = {(1, "a"), (None, "n"), (3, None)}
    assert set(values(joins.left_join_nullsafe(left, right, "k"))) == expected
    assert set(values(joins.natural_left_join(left, right))) == expected
    assert set(values(joins.lookup_join(left, right, "k"))) == expected


def test_natural_join_needs_a_common_column(spark):
    with pytest.raises(ValueError):
        joins.natural_left_join(spark.range(1).toDF("a"), spark.range(1).toDF("b"))


def test_keep_first_keeps_a_null_first_value(spark):
    right = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (None, 5, "n")], "k int, ord int, v string")
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    joined = joins.keep_first_join(left, right, "k", "ord")
    assert sorted(values(joined), key=repr) == sorted([(1, None), (1, None), (2, None), (None, "n")], key=repr)


def test_keep_first_join_keeps_left_columns_on_clash(spark):
    left = spark.createDataFrame([(1, "mine")], "k int, v string")
    right = spark.createDataFrame([(1, 1, "theirs", "new")], "k int, ord int, v string, w string")
    assert values(joins.keep_first_join(left, right, "k", "ord")) == [(1, "mine", "new")]


def test_natural_chain_multiplies_duplicates(spark):
    base = spark.createDataFrame([(7,)], "BIN int")
    twice = spark.createDataFrame([(7, "a"), (7, "b")], "BIN int, s string")
    other = twice.withColumnRenamed("s", "t")
    assert joins.natural_left_join(joins.natural_left_join(base, twice), other).count() == 4


def test_strict_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 1), ("b", 1)], "g string, x int")
    assert dict(values(df.groupBy("g").agg(aggregates.strict_sum(F.col("x"))))) == {"a": None, "b": 2}


def test_medians(spark):
    rows = [("a", "1/1/2021"), ("a", "1/2/2021"), ("b", "1/1/2021"), ("b", "junk"), ("c", None)]
    df = spark.createDataFrame(rows, "g string, d string")
    day = dates.epoch_day(dates.parse_mdy(F.col("d")))
    assert dict(values(aggregates.median_by(df, ["g"], day, "m"))) == {"a": 18628.5, "b": 18628.0, "c": None}
    assert dict(values(aggregates.median_by(df, ["g"], day, "m", strict=True))) == {"a": 18628.5, "b": None, "c": None}


def test_center_on_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "x double")
    assert sorted(values(aggregates.center_on_median(df, {"x": "y"}).select("y")), key=repr) == sorted(
        [(-1.0,), (0.0,), (8.0,), (None,)], key=repr
    )


def test_approval_rate_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", None), ("b", True), ("b", False), ("b", None)], "g string, ok boolean")
    assert dict(values(df.groupBy("g").agg(aggregates.approval_rate(F.col("ok"))))) == {"a": None, "b": 0.5}


def test_pivot_names_the_null_column(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A"), (2, None)], "k int, c string")
    wide = aggregates.pivot_count(df, ["k"], "c", "h_").orderBy("k")
    assert wide.columns == ["k", "h_A", "h_NA"] and values(wide) == [(1, 2, 0), (2, 0, 1)]


def test_count_distinct_counts_null(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "x int")
    assert values(aggregates.count_distinct_rows(df, "x")) == [(2,)]


def test_top_n_keeps_ties(spark):
    scores = [20, 19, 18, 17, 16, 15, 14, 13, 12, 11, 11, 11, 10, None]
    df = one_column(spark, scores, "int")
    assert ranking.top_n_with_ties(df, "x", 10).count() == 12
    assert ranking.top_n_with_ties(df, "x", 50).count() == 13
    assert ranking.top_n_with_ties(df.where("x is null"), "x", 3).count() == 0


def test_any_gate_is_all_or_nothing(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "z int")
    hit, miss = spark.createDataFrame([(2,)], "z int"), spark.createDataFrame([(9,)], "z int")
    assert filters.any_gate(df, "z", hit).count() == 3
    assert filters.any_gate(df, "z", miss).count() == 0
    assert values(joins.focus_on(df, hit, "z")) == [(2,)]


def test_names_are_checked(spark):
    df = spark.range(1).toDF("a")
    with pytest.raises(ValueError):
        columns.drop_columns(df, "b")
    with pytest.raises(ValueError):
        columns.rename(df, {"b": "c"})
    assert columns.drop_columns(df, "b", missing="ignore").columns == ["a"]


def test_drop_containing_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, Predicted int, my_pred int")
    assert columns.drop_containing(df, "pred").columns == ["a"]


def test_suffix_clashes(spark):
    left = spark.createDataFrame([(1, "l")], "k int, v string")
    right = spark.createDataFrame([(1, "r", 2)], "k int, v string, w int")
    a, b = columns.suffix_clashes(left, right, ["k"])
    assert a.join(b, "k").columns == ["k", "v_x", "v_y", "w"]


def test_metrics_without_a_positive_prediction(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (None, 1)], "p int, t int")
    row = evaluation.metrics(df, "p", "t").first()
    assert (row.tn, row.fp, row.fn, row.tp) == (1, 0, 1, 0)
    assert row.precision is None and row.recall == 0.0 and row.accuracy == 0.5


def test_calibration_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(0.0, 1), (0.1, 0), (0.11, 1), (1.0, 1)], "s double, t int")
    table = {r.bin: (r.n, r.events) for r in evaluation.calibration(df, "t", "s", 1).collect()}
    assert table[1] == (2, 1) and table[2] == (1, 1) and table[10] == (1, 1) and len(table) == 10
    # Roles swapped: truth as score and the prediction as class fills the end bins only.
    swapped = {r.bin: r.n for r in evaluation.calibration(df.selectExpr("int(s > 0.1) p", "t"), "p", "t", 0).collect()}
    assert {b for b, n in swapped.items() if n} == {1, 10}


def test_factors_of_too_many_levels_are_refused(spark):
    rows = spark.createDataFrame([(f"l{k % 7}", f"z{k}", None) for k in range(30)] + [(None, None, None)], "a string, b string, c string")
    assert logistic.factor_levels(rows, ["a", "c"]) == {"a": [f"l{k}" for k in range(7)], "c": []}
    assert len(logistic.factor_levels(rows, ["a", "b"], 30)["b"]) == 30
    for most in (29, 6):
        with pytest.raises(ValueError, match="more than"):
            logistic.factor_levels(rows, ["a", "b"], most)
    assert logistic.factor_levels(rows.filter("false"), ["a"]) == {"a": []} and logistic.factor_levels(rows, []) == {}
