"""Registered queries: sources, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlane.catalog.registry import query
from emberlane.catalog.snippets import (
    CORRECTED_BOROUGH,
    FALSE_ALARM,
    FALSE_ALARM_OR_ZERO,
    FIRE_GROUPS as FIRE_GROUPS_SQL,
    PADDED_BOX,
    date,
    moment,
    recoded,
    split_sum as split_sum_sql,
)
from emberlane.catalog.views import VIEWS
from emberlane.functions import dates, logic, text
from emberlane.functions.constants import FIRE_GROUPS, FIRE_MARK
from emberlane.operators import columns, filters
from emberlane.session import scratch_path
from emberlane.sources import read_csv_blank, read_csv_null, read_year, write_by_year

# -- sources and sinks -------------------------------------------------------------------


@query(
    "src_csv_null",
    """SELECT BIN, POSTCODE, nullif(BOROUGH, '') AS BOROUGH, PREM_ADDR, COF_TYPE, EXPIRES_ON, ordinal FROM fitness""",
)
def src_csv_null(t):
    path = scratch_path(t.spark, "csv")
    t.fitness.write.option("header", True).csv(path)
    return read_csv_null(t.spark, path, t.fitness.schema)


@query(
    "src_csv_blank",
    """SELECT BIN, POSTCODE, BOROUGH, coalesce(PREM_ADDR, '') AS PREM_ADDR, coalesce(COF_TYPE, '') AS COF_TYPE,
    EXPIRES_ON, ordinal FROM fitness""",
)
def src_csv_blank(t):
    path = scratch_path(t.spark, "csv")
    raw = t.fitness.withColumnsRenamed({"PREM_ADDR": "PREM ADDR", "COF_TYPE": "COF.TYPE"})
    raw.write.option("header", True).csv(path)
    return read_csv_blank(t.spark, path, raw.schema)


@query("src_csv_reordered", "SELECT BIN, POSTCODE, nullif(BOROUGH, '') AS BOROUGH, PREM_ADDR, COF_TYPE, EXPIRES_ON, ordinal FROM fitness")
def src_csv_reordered(t):
    """The file has the columns in another order, and line breaks inside quotes."""
    path = scratch_path(t.spark, "csv")
    broken = t.fitness.withColumn("COF_TYPE", F.replace("COF_TYPE", F.lit(" "), F.lit("\n")))
    broken = broken.withColumn("BOROUGH", F.nullif("BOROUGH", F.lit("")))
    broken.select(*reversed(broken.columns)).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    read = read_csv_null(t.spark, path, t.fitness.schema, multi_line=True)
    return read.withColumns({"COF_TYPE": F.replace("COF_TYPE", F.lit("\n"), F.lit(" "))})


@query(
    "src_year_partition",
    f"""SELECT *, CAST(year({date('EXPIRES_ON')}) AS INT) AS year FROM fitness
    WHERE year({date('EXPIRES_ON')}) = 1998 OR {date('EXPIRES_ON')} IS NULL""",
)
def src_year_partition(t):
    path = scratch_path(t.spark, "by-year")
    write_by_year(t.fitness.withColumn("year", F.year(dates.parse_mdy(F.col("EXPIRES_ON")))), path)
    return read_year(t.spark, path, 1998).unionByName(read_year(t.spark, path, None))


_PREVIEWED = list(VIEWS["inspections"][0][2])


@query(
    "src_preview",
    "WITH top AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS rn FROM inspections ORDER BY ordinal LIMIT 6) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, "
        + ", ".join(f"max(CASE WHEN rn = {i} THEN CAST({c} AS VARCHAR) END) AS row_{i}" for i in range(1, 7))
        + " FROM top"
        for c in _PREVIEWED
    ),
)
def src_preview(t):
    return columns.preview(t.inspections, "ordinal")


@query("agg_row_count", "SELECT count(*) AS n, 10 AS n_columns FROM incidents")
def agg_row_count(t):
    return t.incidents.agg(F.count(F.lit(1)).alias("n"), F.lit(len(t.incidents.columns)).alias("n_columns"))


# -- projections -------------------------------------------------------------------------


@query("proj_select", "SELECT BIN, LAST_FULL_INSP_DT, LAST_INSP_STAT FROM inspections")
def proj_select(t):
    return t.inspections.select("BIN", "LAST_FULL_INSP_DT", "LAST_INSP_STAT")


@query("proj_drop", "SELECT BIN, POSTCODE, COF_TYPE, EXPIRES_ON, ordinal FROM fitness")
def proj_drop(t):
    return columns.drop_columns(t.fitness, "BOROUGH", "PREM_ADDR")


@query("proj_drop_contains", "SELECT STARFIRE_INCIDENT_ID, ZIPCODE FROM incidents")
def proj_drop_contains(t):
    scored = t.incidents.select(
        "STARFIRE_INCIDENT_ID",
        "ZIPCODE",
        F.lit(0.5).alias("predicted_prob"),
        F.col("ZIPCODE").alias("Pred_zip"),
        F.lit(1).alias("prediction_knn"),
    )
    return columns.drop_containing(scored, "pred")


@query("proj_rename", "SELECT POSTCODE AS ZIPCODE, ALPHA AS hazardous_level, BIN FROM inspections")
def proj_rename(t):
    return columns.rename(t.inspections.select("POSTCODE", "ALPHA", "BIN"), {"POSTCODE": "ZIPCODE", "ALPHA": "hazardous_level"})


@query(
    "proj_derive",
    f"""SELECT STARFIRE_INCIDENT_ID, {FALSE_ALARM} AS false_alarm, {moment('INCIDENT_DATETIME')} AS INCIDENT_DATETIME,
    CAST(month({moment('INCIDENT_DATETIME')}) AS INT) AS incident_month,
    CAST(hour({moment('INCIDENT_DATETIME')}) AS INT) AS incident_hour,
    dayname({moment('INCIDENT_DATETIME')}) AS incident_weekday, {PADDED_BOX} AS ALARM_BOX_NUMBER FROM incidents""",
)
def proj_derive(t):
    from emberlane.plans.incidents import clean_incidents

    return clean_incidents(t.incidents).select(
        "STARFIRE_INCIDENT_ID",
        "false_alarm",
        F.col("INCIDENT_DATETIME").cast("timestamp_ntz").alias("INCIDENT_DATETIME"),
        "incident_month",
        "incident_hour",
        "incident_weekday",
        "ALARM_BOX_NUMBER",
    )


@query(
    "proj_try_cast",
    """SELECT STARFIRE_INCIDENT_ID, TRY_CAST(ALARM_BOX_NUMBER AS INTEGER) AS box, TRY_CAST(INCIDENT_BOROUGH AS DOUBLE) AS borough,
    CAST(ZIPCODE AS DOUBLE) AS zip FROM incidents""",
)
def proj_try_cast(t):
    return t.incidents.select(
        "STARFIRE_INCIDENT_ID",
        F.col("ALARM_BOX_NUMBER").try_cast("int").alias("box"),
        F.col("INCIDENT_BOROUGH").try_cast("double").alias("borough"),
        F.col("ZIPCODE").try_cast("double").alias("zip"),
    )


_SUMMARY = [
    "BIN",
    "NUM_SIAM_SPRINKLER",
    "SPRINKLER_TYPE",
    "NUM_SIAM_STANDPIPE",
    "STANDPIPE_TYPE",
    "NUM_OF_VIOLATION_NOTICES",
    "NUM_OF_VIOLATION_ORDER",
]


@query("proj_cast_all", "SELECT " + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in _SUMMARY) + " FROM summary")
def proj_cast_all(t):
    return columns.cast_all(t.summary)


@query(
    "proj_level_collapse",
    """SELECT STARFIRE_INCIDENT_ID, CASE WHEN INCIDENT_CLASSIFICATION IN ('Alarm System - Defective', 'Alarm System - Unnecessary')
    THEN '1' WHEN INCIDENT_CLASSIFICATION IS NOT NULL THEN '0' END AS INCIDENT_CLASSIFICATION FROM incidents""",
)
def proj_level_collapse(t):
    return t.incidents.select(
        "STARFIRE_INCIDENT_ID", logic.collapse_false_alarms(F.col("INCIDENT_CLASSIFICATION")).alias("INCIDENT_CLASSIFICATION")
    )


# -- filters -----------------------------------------------------------------------------


@query("flt_ne", "SELECT BIN, POSTCODE, ordinal FROM inspections WHERE BIN <> 0")
def flt_ne(t):
    return t.inspections.where(F.col("BIN") != 0).select("BIN", "POSTCODE", "ordinal")


@query("flt_contains", "SELECT BIN, COF_TYPE, ordinal FROM fitness WHERE contains(COF_TYPE, 'FIRE')")
def flt_contains(t):
    return t.fitness.where(F.col("COF_TYPE").contains(FIRE_MARK)).select("BIN", "COF_TYPE", "ordinal")


@query(
    "flt_in_derived_set",
    """SELECT BIN, COF_TYPE, ordinal FROM fitness
    WHERE COF_TYPE IN (SELECT DISTINCT COF_TYPE FROM fitness WHERE contains(COF_TYPE, 'FIRE'))""",
)
def flt_in_derived_set(t):
    return filters.in_derived_set(t.fitness, "COF_TYPE", FIRE_MARK).select("BIN", "COF_TYPE", "ordinal")


@query("flt_isin", f"SELECT STARFIRE_INCIDENT_ID, INCIDENT_CLASSIFICATION_GROUP AS grp FROM incidents WHERE grp IN {FIRE_GROUPS_SQL}")
def flt_isin(t):
    return t.incidents.where(F.col("INCIDENT_CLASSIFICATION_GROUP").isin(FIRE_GROUPS)).select(
        "STARFIRE_INCIDENT_ID", F.col("INCIDENT_CLASSIFICATION_GROUP").alias("grp")
    )


@query(
    "flt_any_gate",
    """SELECT STARFIRE_INCIDENT_ID, ZIPCODE FROM incidents WHERE EXISTS (SELECT 1 FROM incidents i WHERE i.ZIPCODE IN
    (SELECT POSTCODE FROM violations WHERE ACTION = '1-URGENT'))""",
)
def flt_any_gate(t):
    urgent = t.violations.where("ACTION = '1-URGENT'").select(F.col("POSTCODE").alias("ZIPCODE"))
    return filters.any_gate(t.incidents, "ZIPCODE", urgent).select("STARFIRE_INCIDENT_ID", "ZIPCODE")


_INSPECTED = list(VIEWS["inspections"][0][2])


@query(
    "flt_dropna",
    f"SELECT {', '.join(_INSPECTED)} FROM inspections WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _INSPECTED),
)
def flt_dropna(t):
    return t.inspections.na.drop("any")


@query("flt_between", f"SELECT BIN, EXPIRES_ON, ordinal FROM fitness WHERE year({date('EXPIRES_ON')}) BETWEEN 1996 AND 1998")
def flt_between(t):
    return t.fitness.where(F.year(dates.parse_mdy(F.col("EXPIRES_ON"))).between(1996, 1998)).select("BIN", "EXPIRES_ON", "ordinal")


@query("flt_year", f"SELECT BIN, EXPIRES_ON, ordinal FROM fitness WHERE year({date('EXPIRES_ON')}) > 1999")
def flt_year(t):
    return t.fitness.where(dates.year_after(dates.parse_mdy(F.col("EXPIRES_ON")), 1999)).select("BIN", "EXPIRES_ON", "ordinal")


@query("flt_drop_first", "SELECT * FROM fitness WHERE ordinal <> (SELECT min(ordinal) FROM fitness)")
def flt_drop_first(t):
    return filters.drop_first_row(t.fitness, "ordinal")


@query("flt_correction_table", f"SELECT ordinal, PREM_ADDR, {CORRECTED_BOROUGH} AS BOROUGH FROM fitness")
def flt_correction_table(t):
    return t.fitness.select(
        "ordinal", "PREM_ADDR", logic.corrected_borough(F.col("BOROUGH"), F.col("PREM_ADDR")).alias("BOROUGH")
    )


# -- scalar functions --------------------------------------------------------------------


@query("fn_ifelse_null", f"SELECT STARFIRE_INCIDENT_ID, {FALSE_ALARM} AS false_alarm FROM incidents")
def fn_ifelse_null(t):
    return t.incidents.select("STARFIRE_INCIDENT_ID", logic.false_alarm(F.col("INCIDENT_CLASSIFICATION")).alias("false_alarm"))


@query("fn_case_default", f"SELECT STARFIRE_INCIDENT_ID, {FALSE_ALARM_OR_ZERO} AS false_alarm FROM incidents")
def fn_case_default(t):
    return t.incidents.select(
        "STARFIRE_INCIDENT_ID", logic.false_alarm_or_zero(F.col("INCIDENT_CLASSIFICATION")).alias("false_alarm")
    )


_TEXTS = ("BOROUGH", "PREM_ADDR", "COF_TYPE", "EXPIRES_ON")


@query("fn_recode_all", f"SELECT BIN, POSTCODE, ordinal, {', '.join(f'{recoded(c)} AS {c}' for c in _TEXTS)} FROM fitness")
def fn_recode_all(t):
    return logic.recode_boroughs(t.fitness)


@query("fn_pad_box", f"SELECT STARFIRE_INCIDENT_ID, {PADDED_BOX} AS box FROM incidents")
def fn_pad_box(t):
    return t.incidents.select("STARFIRE_INCIDENT_ID", text.pad_box(F.col("ALARM_BOX_NUMBER")).alias("box"))


@query(
    "fn_pad_box_keep",
    """SELECT STARFIRE_INCIDENT_ID, CASE WHEN length(ALARM_BOX_NUMBER) BETWEEN 1 AND 3 THEN lpad(ALARM_BOX_NUMBER, 4, '0')
    ELSE ALARM_BOX_NUMBER END AS box FROM incidents""",
)
def fn_pad_box_keep(t):
    return t.incidents.select("STARFIRE_INCIDENT_ID", text.pad_box_keep(F.col("ALARM_BOX_NUMBER")).alias("box"))


@query("fn_drop_first_char", "SELECT ordinal, substring(BOROBOX, 2) AS box FROM boxes")
def fn_drop_first_char(t):
    return t.boxes.select("ordinal", text.drop_first_char(F.col("BOROBOX")).alias("box"))


@query(
    "fn_split_sum",
    f"""SELECT BIN, NUM_SIAM_SPRINKLER, {split_sum_sql('NUM_SIAM_SPRINKLER')} AS sprinklers,
    {split_sum_sql('NUM_SIAM_STANDPIPE')} AS standpipes FROM summary""",
)
def fn_split_sum(t):
    return t.summary.select(
        "BIN",
        "NUM_SIAM_SPRINKLER",
        text.split_sum(F.col("NUM_SIAM_SPRINKLER")).alias("sprinklers"),
        text.split_sum(F.col("NUM_SIAM_STANDPIPE")).alias("standpipes"),
    )


@query("fn_parse_mdy", f"SELECT ordinal, CAST({date('EXPIRES_ON')} AS VARCHAR) AS expires FROM fitness")
def fn_parse_mdy(t):
    return t.fitness.select("ordinal", dates.parse_mdy(F.col("EXPIRES_ON")).cast("string").alias("expires"))


@query("fn_parse_mdy_hms", f"SELECT STARFIRE_INCIDENT_ID, {moment('INCIDENT_DATETIME')} AS moment FROM incidents")
def fn_parse_mdy_hms(t):
    return t.incidents.select(
        "STARFIRE_INCIDENT_ID", dates.parse_mdy_hms(F.col("INCIDENT_DATETIME")).cast("timestamp_ntz").alias("moment")
    )


@query(
    "fn_truncate_date",
    f"""SELECT STARFIRE_INCIDENT_ID, CAST(CAST({moment('INCIDENT_DATETIME')} AS DATE) AS VARCHAR) AS day,
    strftime({moment('INCIDENT_DATETIME')}, '%m/%d/%Y') AS day_text FROM incidents""",
)
def fn_truncate_date(t):
    at = dates.parse_mdy_hms(F.col("INCIDENT_DATETIME"))
    return t.incidents.select(
        "STARFIRE_INCIDENT_ID", F.to_date(at).cast("string").alias("day"), F.date_format(at, "MM/dd/yyyy").alias("day_text")
    )


@query(
    "fn_date_parts",
    f"""SELECT STARFIRE_INCIDENT_ID, CAST(year(mo) AS INT) AS y, CAST(month(mo) AS INT) AS m, CAST(hour(mo) AS INT) AS h,
    dayname(mo) AS weekday, monthname(mo) AS month_name
    FROM (SELECT STARFIRE_INCIDENT_ID, {moment('INCIDENT_DATETIME')} AS mo FROM incidents)""",
)
def fn_date_parts(t):
    at = t.incidents.select("STARFIRE_INCIDENT_ID", dates.parse_mdy_hms(F.col("INCIDENT_DATETIME")).alias("at"))
    return at.select(
        "STARFIRE_INCIDENT_ID",
        F.year("at").alias("y"),
        F.month("at").alias("m"),
        F.hour("at").alias("h"),
        dates.weekday_name(F.col("at")).alias("weekday"),
        dates.month_name(F.col("at")).alias("month_name"),
    )


@query(
    "fn_days_between",
    f"""SELECT ordinal, CAST(date_diff('day', {date('LAST_FULL_INSP_DT')}, DATE '2001-01-01') AS INT) AS days FROM inspections""",
)
def fn_days_between(t):
    return t.inspections.select(
        "ordinal", dates.days_between(F.make_date(F.lit(2001), F.lit(1), F.lit(1)), dates.parse_mdy(F.col("LAST_FULL_INSP_DT"))).alias("days")
    )


@query(
    "fn_fill_zero",
    """SELECT BIN, coalesce(NUM_OF_VIOLATION_NOTICES, 0) AS NUM_OF_VIOLATION_NOTICES,
    coalesce(NUM_OF_VIOLATION_ORDER, 0) AS NUM_OF_VIOLATION_ORDER FROM summary""",
)
def fn_fill_zero(t):
    return t.summary.select("BIN", "NUM_OF_VIOLATION_NOTICES", "NUM_OF_VIOLATION_ORDER").fillna(
        0, ["NUM_OF_VIOLATION_NOTICES", "NUM_OF_VIOLATION_ORDER"]
    )
