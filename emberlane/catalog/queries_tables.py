"""Registered queries: joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlane.catalog.registry import query
from emberlane.catalog.snippets import FALSE_ALARM, date, day, split_sum as split_sum_sql
from emberlane.catalog.views import VIEWS
from emberlane.functions import dates, logic, text
from emberlane.functions.constants import APPROVED_STATUS, VIOLATION_STATUSES
from emberlane.operators import aggregates, columns, joins, ranking
from emberlane.plans import bin_features, zip_features
from emberlane.plans.incidents import false_alarms_by_borough

_STATUS_SQL = "('NOT APPROVAL(W/REASON)', 'NOT APPROVAL(VIO)')"
_BY_ZIP_SQL = f"""fa AS (SELECT ZIPCODE, CASE WHEN count(*) = count(f) THEN CAST(sum(f) AS BIGINT) END AS number_of_false_alarms
    FROM (SELECT ZIPCODE, {FALSE_ALARM} AS f FROM incidents) GROUP BY ZIPCODE)"""

# -- joins -------------------------------------------------------------------------------


def _violation_counts(t):
    return t.inspections.groupBy(F.col("POSTCODE").alias("ZIPCODE")).agg(
        aggregates.count_matching(F.col("LAST_INSP_STAT"), VIOLATION_STATUSES).alias("last_inspection_status_vio")
    )


@query(
    "join_left_nullsafe",
    f"""WITH {_BY_ZIP_SQL}, ins AS (SELECT POSTCODE, count(*) FILTER (WHERE LAST_INSP_STAT IN {_STATUS_SQL}) AS v
    FROM inspections GROUP BY POSTCODE)
    SELECT fa.*, v AS last_inspection_status_vio FROM fa LEFT JOIN ins ON ZIPCODE IS NOT DISTINCT FROM POSTCODE""",
)
def join_left_nullsafe(t):
    return joins.left_join_nullsafe(zip_features.false_alarms_by_zip(t.incidents), _violation_counts(t), "ZIPCODE")


@query(
    "join_left_string_key",
    f"""WITH {_BY_ZIP_SQL}, app AS (SELECT CAST(POSTCODE AS VARCHAR) AS k,
    count(*) FILTER (WHERE LAST_INSP_STAT = 'APPROVAL') / nullif(count(LAST_INSP_STAT), 0) AS p
    FROM inspections WHERE BIN <> 0 GROUP BY POSTCODE)
    SELECT CAST(ZIPCODE AS VARCHAR) AS ZIPCODE, number_of_false_alarms, p AS proportion_approved
    FROM fa LEFT JOIN app ON CAST(ZIPCODE AS VARCHAR) IS NOT DISTINCT FROM k""",
)
def join_left_string_key(t):
    alarms = zip_features.false_alarms_by_zip(t.incidents).withColumn("ZIPCODE", F.col("ZIPCODE").cast("string"))
    rates = (
        t.inspections.where(F.col("BIN") != 0)
        .groupBy(F.col("POSTCODE").cast("string").alias("ZIPCODE"))
        .agg(aggregates.approval_rate(F.col("LAST_INSP_STAT") == APPROVED_STATUS).alias("proportion_approved"))
    )
    return joins.left_join_nullsafe(alarms, rates, "ZIPCODE")


@query(
    "join_broadcast_dim",
    f"""WITH ins AS (SELECT POSTCODE, count(*) FILTER (WHERE LAST_INSP_STAT IN {_STATUS_SQL}) AS v FROM inspections GROUP BY POSTCODE)
    SELECT STARFIRE_INCIDENT_ID, ZIPCODE, v AS last_inspection_status_vio
    FROM incidents LEFT JOIN ins ON ZIPCODE IS NOT DISTINCT FROM POSTCODE""",
)
def join_broadcast_dim(t):
    return joins.lookup_join(t.incidents.select("STARFIRE_INCIDENT_ID", "ZIPCODE"), _violation_counts(t), "ZIPCODE")


@query(
    "join_natural_chain",
    f"""WITH s AS (SELECT BIN, {split_sum_sql('NUM_SIAM_SPRINKLER')} AS NUM_SIAM_SPRINKLER, SPRINKLER_TYPE,
      {split_sum_sql('NUM_SIAM_STANDPIPE')} AS NUM_SIAM_STANDPIPE, STANDPIPE_TYPE FROM summary WHERE BIN <> 0),
    c AS (SELECT BIN, count(*) AS num_recent_fire_fitness_certs FROM fitness WHERE contains(COF_TYPE, 'FIRE')
      AND PREM_ADDR IS NOT NULL AND year({date('EXPIRES_ON')}) BETWEEN 1996 AND 1998 GROUP BY BIN)
    SELECT s.*, num_recent_fire_fitness_certs, NUM_OF_VIOLATION_NOTICES, NUM_OF_VIOLATION_ORDER FROM s
    LEFT JOIN c ON s.BIN = c.BIN LEFT JOIN summary o ON s.BIN = o.BIN""",
)
def join_natural_chain(t):
    # Buildings without a number are nobody's neighbours: left in, they would all match each other.
    numbered = bin_features.sprinklers(t.summary.where("BIN <> 0"))
    chain = joins.natural_left_join(numbered, bin_features.recent_fire_certificates(t.fitness, 1996, 1998), null_safe=False)
    return joins.natural_left_join(chain, bin_features.open_violations(t.summary), null_safe=False)


@query(
    "join_keep_first",
    """WITH f AS (SELECT * FROM violations QUALIFY row_number() OVER (PARTITION BY POSTCODE ORDER BY ordinal) = 1)
    SELECT STARFIRE_INCIDENT_ID, ZIPCODE, f.ACTION, f.VIO_DATE FROM incidents LEFT JOIN f ON ZIPCODE IS NOT DISTINCT FROM f.POSTCODE""",
)
def join_keep_first(t):
    found = t.violations.select(F.col("POSTCODE").alias("ZIPCODE"), "ACTION", "VIO_DATE", "ordinal")
    return joins.keep_first_join(t.incidents.select("STARFIRE_INCIDENT_ID", "ZIPCODE"), found, "ZIPCODE", "ordinal")


@query(
    "join_normalised_key",
    """WITH b AS (SELECT *, TRY_CAST(substring(BOROBOX, 2) AS INTEGER) AS k FROM boxes
      QUALIFY row_number() OVER (PARTITION BY TRY_CAST(substring(BOROBOX, 2) AS INTEGER) ORDER BY ordinal) = 1)
    SELECT STARFIRE_INCIDENT_ID, TRY_CAST(ALARM_BOX_NUMBER AS INTEGER) AS ALARM_BOX_NUMBER, LOCATION, ZIP
    FROM incidents LEFT JOIN b ON TRY_CAST(ALARM_BOX_NUMBER AS INTEGER) IS NOT DISTINCT FROM k""",
)
def join_normalised_key(t):
    incidents = t.incidents.select("STARFIRE_INCIDENT_ID", text.box_key(F.col("ALARM_BOX_NUMBER")).alias("ALARM_BOX_NUMBER"))
    boxes = t.boxes.select(
        text.box_key(text.drop_first_char(F.col("BOROBOX"))).alias("ALARM_BOX_NUMBER"), "LOCATION", "ZIP", "ordinal"
    )
    return joins.keep_first_join(incidents, boxes, "ALARM_BOX_NUMBER", "ordinal")


@query(
    "join_suffixes",
    """SELECT ordinal, f.BOROUGH AS BOROUGH_x, f.COF_TYPE, v.BOROUGH AS BOROUGH_y, v.ACTION FROM fitness f JOIN violations v USING (ordinal)""",
)
def join_suffixes(t):
    left, right = columns.suffix_clashes(
        t.fitness.select("ordinal", "BOROUGH", "COF_TYPE"), t.violations.select("ordinal", "BOROUGH", "ACTION"), ["ordinal"]
    )
    return left.join(right, "ordinal")


@query(
    "join_semi_focus",
    """SELECT STARFIRE_INCIDENT_ID, ZIPCODE FROM incidents
    WHERE ZIPCODE IN (SELECT POSTCODE FROM violations WHERE ACTION = '1-URGENT')""",
)
def join_semi_focus(t):
    urgent = t.violations.where("ACTION = '1-URGENT'").select(F.col("POSTCODE").alias("ZIPCODE"))
    return joins.focus_on(t.incidents.select("STARFIRE_INCIDENT_ID", "ZIPCODE"), urgent, "ZIPCODE")


@query(
    "join_scalar_center",
    f"""WITH m AS (SELECT POSTCODE, median({day('VIO_DATE')}) AS median_violation_date FROM violations GROUP BY POSTCODE)
    SELECT POSTCODE AS ZIPCODE, median_violation_date,
    median_violation_date - (SELECT median(median_violation_date) FROM m) AS days_from_median_violation_date FROM m""",
)
def join_scalar_center(t):
    medians = zip_features.date_medians_by_zip(t.violations, "VIO_DATE", "median_violation_date")
    return aggregates.center_on_median(medians, {"median_violation_date": "days_from_median_violation_date"})


# -- set operations ----------------------------------------------------------------------


@query("set_difference", "SELECT BIN FROM inspections EXCEPT SELECT BIN FROM fitness")
def set_difference(t):
    return t.inspections.select("BIN").subtract(t.fitness.select("BIN"))


@query(
    "set_union_by_name",
    "SELECT BIN, POSTCODE, BOROUGH FROM fitness UNION ALL SELECT BIN, POSTCODE, BOROUGH FROM violations",
)
def set_union_by_name(t):
    return t.fitness.select("BIN", "POSTCODE", "BOROUGH").unionByName(t.violations.select("BOROUGH", "POSTCODE", "BIN"))


# -- aggregates --------------------------------------------------------------------------


@query("agg_sum_strict", f"WITH {_BY_ZIP_SQL} SELECT * FROM fa")
def agg_sum_strict(t):
    return zip_features.false_alarms_by_zip(t.incidents)


@query(
    "agg_count_if",
    f"""SELECT POSTCODE AS ZIPCODE, count(*) FILTER (WHERE LAST_INSP_STAT IN {_STATUS_SQL}) AS last_inspection_status_vio
    FROM inspections GROUP BY POSTCODE""",
)
def agg_count_if(t):
    return _violation_counts(t)


@query("agg_median_date", f"SELECT POSTCODE, median({day('EXPIRES_ON')}) AS median_day FROM fitness GROUP BY POSTCODE")
def agg_median_date(t):
    return aggregates.median_by(t.fitness, ["POSTCODE"], dates.epoch_day(dates.parse_mdy(F.col("EXPIRES_ON"))), "median_day")


@query(
    "agg_median_date_strict",
    f"""SELECT POSTCODE, CASE WHEN count(*) = count({day('LAST_FULL_INSP_DT')}) THEN median({day('LAST_FULL_INSP_DT')}) END
    AS median_day FROM inspections GROUP BY POSTCODE""",
)
def agg_median_date_strict(t):
    inspected = dates.epoch_day(dates.parse_mdy(F.col("LAST_FULL_INSP_DT")))
    return aggregates.median_by(t.inspections, ["POSTCODE"], inspected, "median_day", strict=True)


@query("agg_count", "SELECT BIN, LAST_INSP_STAT, count(*) AS n FROM inspections GROUP BY BIN, LAST_INSP_STAT")
def agg_count(t):
    return t.inspections.groupBy("BIN", "LAST_INSP_STAT").agg(F.count(F.lit(1)).alias("n"))


@query("agg_distinct", "SELECT DISTINCT BIN, POSTCODE, BOROUGH FROM inspections")
def agg_distinct(t):
    return t.inspections.select("BIN", "POSTCODE", "BOROUGH").distinct()


@query("agg_count_distinct", "SELECT count(*) AS n FROM (SELECT DISTINCT POSTCODE FROM inspections)")
def agg_count_distinct(t):
    return aggregates.count_distinct_rows(t.inspections, "POSTCODE")


@query(
    "agg_freq",
    "SELECT LAST_INSP_STAT, count(*) AS n FROM inspections WHERE LAST_INSP_STAT IS NOT NULL GROUP BY LAST_INSP_STAT",
)
def agg_freq(t):
    return aggregates.frequency(t.inspections, "LAST_INSP_STAT")


_LEVELS_SQL = (
    ", ".join(f"count(*) FILTER (WHERE ALPHA = 'H{i}') AS hazard_H{i}" for i in range(4))
    + ", count(*) FILTER (WHERE ALPHA IS NULL) AS hazard_NA"
)


@query("agg_pivot_fill", f"SELECT BIN, {_LEVELS_SQL} FROM inspections WHERE BIN <> 0 GROUP BY BIN")
def agg_pivot_fill(t):
    return aggregates.pivot_count(t.inspections.where(F.col("BIN") != 0), ["BIN"], "ALPHA", "hazard_")


_LEVELS = ["BIN", "hazard_H0", "hazard_H1", "hazard_H2", "hazard_H3", "hazard_NA"]


@query(
    "agg_col_means",
    f"WITH h AS (SELECT BIN, {_LEVELS_SQL} FROM inspections WHERE BIN <> 0 GROUP BY BIN) SELECT "
    + ", ".join(f"avg({c}) AS {c}" for c in _LEVELS)
    + " FROM h",
)
def agg_col_means(t):
    return aggregates.column_means(agg_pivot_fill(t))


_PROFILED = list(VIEWS["inspections"][0][2])


@query(
    "agg_null_profile",
    "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _PROFILED) + " FROM inspections",
)
def agg_null_profile(t):
    return aggregates.null_profile(t.inspections)


@query(
    "agg_first_row",
    """SELECT POSTCODE, BIN, ALPHA, LAST_INSP_STAT FROM inspections
    QUALIFY row_number() OVER (PARTITION BY POSTCODE ORDER BY ordinal) = 1""",
)
def agg_first_row(t):
    return joins.keep_first(t.inspections.select("POSTCODE", "BIN", "ALPHA", "LAST_INSP_STAT", "ordinal"), "POSTCODE", "ordinal")


@query(
    "agg_approval_rate",
    """SELECT POSTCODE, count(*) FILTER (WHERE LAST_INSP_STAT = 'APPROVAL') / nullif(count(LAST_INSP_STAT), 0) AS proportion_approved
    FROM inspections WHERE BIN <> 0 GROUP BY POSTCODE""",
)
def agg_approval_rate(t):
    approved = F.col("LAST_INSP_STAT") == APPROVED_STATUS
    return t.inspections.where(F.col("BIN") != 0).groupBy("POSTCODE").agg(
        aggregates.approval_rate(approved).alias("proportion_approved")
    )


@query(
    "agg_by_borough",
    f"""SELECT INCIDENT_BOROUGH, CAST(sum({FALSE_ALARM}) AS BIGINT) AS number_of_false_alarms FROM incidents GROUP BY INCIDENT_BOROUGH""",
)
def agg_by_borough(t):
    flagged = t.incidents.select("INCIDENT_BOROUGH", logic.false_alarm(F.col("INCIDENT_CLASSIFICATION")).alias("false_alarm"))
    return false_alarms_by_borough(flagged)


# -- windows and sorts -------------------------------------------------------------------


@query(
    "win_share_of_group",
    """SELECT BIN, LAST_INSP_STAT, n, n / sum(n) OVER (PARTITION BY BIN) AS share
    FROM (SELECT BIN, LAST_INSP_STAT, count(*) AS n FROM inspections GROUP BY BIN, LAST_INSP_STAT)""",
)
def win_share_of_group(t):
    return aggregates.share_of_group(t.inspections, ["BIN"], "LAST_INSP_STAT")


@query(
    "win_top_n_ties",
    """WITH b AS (SELECT BIN, count(*) AS inspections_done FROM inspections GROUP BY BIN)
    SELECT * FROM b QUALIFY rank() OVER (ORDER BY inspections_done DESC) <= 10""",
)
def win_top_n_ties(t):
    done = t.inspections.groupBy("BIN").agg(F.count(F.lit(1)).alias("inspections_done"))
    return ranking.top_n_with_ties(done, "inspections_done", 10)


@query("sort_asc_nulls_last", "SELECT STARFIRE_INCIDENT_ID, ZIPCODE FROM incidents ORDER BY ZIPCODE ASC NULLS LAST, STARFIRE_INCIDENT_ID")
def sort_asc_nulls_last(t):
    return t.incidents.select("STARFIRE_INCIDENT_ID", "ZIPCODE").orderBy(
        F.col("ZIPCODE").asc_nulls_last(), "STARFIRE_INCIDENT_ID"
    )


@query("sort_limit", "SELECT DISTINCT BIN, POSTCODE FROM inspections ORDER BY BIN, POSTCODE NULLS LAST LIMIT 6")
def sort_limit(t):
    return ranking.sorted_distinct(t.inspections, ["BIN", "POSTCODE"]).limit(6)


@query(
    "sort_distinct",
    """SELECT DISTINCT ALARM_BOX_NUMBER, INCIDENT_BOROUGH FROM incidents
    ORDER BY ALARM_BOX_NUMBER NULLS LAST, INCIDENT_BOROUGH NULLS LAST""",
)
def sort_distinct(t):
    return ranking.sorted_distinct(t.incidents, ["ALARM_BOX_NUMBER", "INCIDENT_BOROUGH"])
