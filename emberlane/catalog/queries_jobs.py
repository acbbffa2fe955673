"""Registered queries: the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlane.catalog.queries_models import features_of
from emberlane.catalog.registry import query
from emberlane.catalog.snippets import (
    CORRECTED_BOROUGH,
    ZIP_FEATURES,
    date,
    moment,
    nearest,
    recoded,
    split,
    split_sum,
)
from emberlane.plans.bin_features import bin_features
from emberlane.plans.catalogues import address_catalogue, box_catalogue
from emberlane.plans.enrich_incidents import enrich_incidents
from emberlane.plans.partition_by_year import one_year
from emberlane.plans.zip_features import zip_features
from emberlane.plans.zips_in_focus import zips_in_focus
from emberlane.session import scratch_path


@query("job_zip_features", f"WITH {ZIP_FEATURES} SELECT * FROM zf")
def job_zip_features(t):
    return zip_features(t.incidents, t.inspections, t.fitness, t.violations)


@query(
    "job_zips_in_focus",
    f"""WITH {ZIP_FEATURES}, s AS ({split('zf', 'ZIPCODE')}), known AS (SELECT * FROM s WHERE split <> 'test'),
    p AS ({nearest('known', 'zf')}) SELECT zf.*, prediction AS predictions FROM zf JOIN p USING (ZIPCODE) WHERE prediction = 1""",
)
def job_zips_in_focus(t):
    return zips_in_focus(features_of(t))


_BIN_FEATURES = f"""WITH h AS (SELECT BIN, {', '.join(f"count(*) FILTER (WHERE ALPHA = 'H{i}') AS hazard_H{i}" for i in range(4))},
      count(*) FILTER (WHERE ALPHA IS NULL) AS hazard_NA, count(*) FILTER (WHERE LAST_INSP_STAT = 'APPROVAL') AS approved_TRUE,
      count(*) FILTER (WHERE LAST_INSP_STAT <> 'APPROVAL') AS approved_FALSE FROM inspections WHERE BIN <> 0 GROUP BY BIN),
    s AS (SELECT BIN, {split_sum('NUM_SIAM_SPRINKLER')} AS NUM_SIAM_SPRINKLER, SPRINKLER_TYPE,
      {split_sum('NUM_SIAM_STANDPIPE')} AS NUM_SIAM_STANDPIPE, STANDPIPE_TYPE FROM summary),
    c AS (SELECT BIN, count(*) AS k FROM fitness WHERE contains(COF_TYPE, 'FIRE') AND PREM_ADDR IS NOT NULL
      AND year({date('EXPIRES_ON')}) BETWEEN 1996 AND 1998 GROUP BY BIN)
    SELECT h.BIN, hazard_H0, hazard_H1, hazard_H2, hazard_H3, hazard_NA, s.NUM_SIAM_SPRINKLER, s.SPRINKLER_TYPE,
      s.NUM_SIAM_STANDPIPE, s.STANDPIPE_TYPE, approved_TRUE, approved_FALSE,
      approved_TRUE / nullif(approved_TRUE + approved_FALSE, 0) AS proportion_approved,
      coalesce(k, 0) AS num_recent_fire_fitness_certs, coalesce(o.NUM_OF_VIOLATION_NOTICES, 0) AS NUM_OF_VIOLATION_NOTICES,
      coalesce(o.NUM_OF_VIOLATION_ORDER, 0) AS NUM_OF_VIOLATION_ORDER
    FROM h LEFT JOIN s ON h.BIN = s.BIN LEFT JOIN c ON h.BIN = c.BIN LEFT JOIN summary o ON h.BIN = o.BIN"""
# The summary joined once: its sprinklers and its violations come from the same row.
_ONCE = (
    _BIN_FEATURES.replace("STANDPIPE_TYPE FROM summary", "STANDPIPE_TYPE, NUM_OF_VIOLATION_NOTICES, NUM_OF_VIOLATION_ORDER FROM summary")
    .replace(" LEFT JOIN summary o ON h.BIN = o.BIN", "")
    .replace("o.NUM", "s.NUM")
)


@query("job_bin_features", _ONCE)
def job_bin_features(t):
    return bin_features(t.inspections, t.fitness, t.summary, 1996, 1998)


@query("job_bin_features_literal", _BIN_FEATURES)
def job_bin_features_literal(t):
    return bin_features(t.inspections, t.fitness, t.summary, 1996, 1998, pair_summaries=True)


@query(
    "job_enrich_incidents",
    f"""WITH b AS (SELECT TRY_CAST(substring(BOROBOX, 2) AS INTEGER) AS k, BOROUGH FROM boxes
      QUALIFY row_number() OVER (PARTITION BY TRY_CAST(substring(BOROBOX, 2) AS INTEGER) ORDER BY ordinal) = 1),
    f AS (SELECT POSTCODE, {date('EXPIRES_ON')} AS e, PREM_ADDR FROM fitness WHERE ordinal <> (SELECT min(ordinal) FROM fitness)
      AND year({date('EXPIRES_ON')}) > 1997 QUALIFY row_number() OVER (PARTITION BY POSTCODE ORDER BY ordinal) = 1),
    i AS (SELECT * FROM inspections QUALIFY row_number() OVER (PARTITION BY POSTCODE ORDER BY ordinal) = 1),
    v AS (SELECT * FROM violations QUALIFY row_number() OVER (PARTITION BY POSTCODE ORDER BY ordinal) = 1),
    d AS (SELECT *, CAST({moment('INCIDENT_DATETIME')} AS DATE) AS dt, TRY_CAST(ALARM_BOX_NUMBER AS INTEGER) AS box FROM incidents)
    SELECT CAST(dt AS VARCHAR) AS INCIDENT_DATETIME,
      CASE WHEN INCIDENT_CLASSIFICATION IN ('Alarm System - Defective', 'Alarm System - Unnecessary') THEN '1'
        WHEN INCIDENT_CLASSIFICATION IS NOT NULL THEN '0' END AS INCIDENT_CLASSIFICATION,
      INCIDENT_CLASSIFICATION_GROUP, box AS ALARM_BOX_NUMBER, ZIPCODE, b.BOROUGH,
      CAST(e AS VARCHAR) AS EXPIRES_ON, f.PREM_ADDR, i.LAST_VISIT_DT, CAST({date('i.LAST_FULL_INSP_DT')} AS VARCHAR) AS LAST_FULL_INSP_DT,
      i.LAST_INSP_STAT, v.VIO_LAW_NUM, v.VIO_LAW_DESC, v.VIO_DATE, v.ACTION,
      CAST(date_diff('day', {date('i.LAST_FULL_INSP_DT')}, dt) AS INT) AS days_after_last_inspection
    FROM d LEFT JOIN b ON box IS NOT DISTINCT FROM k LEFT JOIN f ON ZIPCODE IS NOT DISTINCT FROM f.POSTCODE
    LEFT JOIN i ON ZIPCODE IS NOT DISTINCT FROM i.POSTCODE LEFT JOIN v ON ZIPCODE IS NOT DISTINCT FROM v.POSTCODE""",
)
def job_enrich_incidents(t):
    enriched = enrich_incidents(t.incidents, t.boxes, t.fitness, t.inspections, t.violations, after_year=1997)
    return enriched.withColumns(
        {c: F.col(c).cast("string") for c in ("INCIDENT_DATETIME", "EXPIRES_ON", "LAST_FULL_INSP_DT")}
    )


@query(
    "src_fitness_cleaned",
    f"""SELECT ordinal, {recoded('(' + CORRECTED_BOROUGH + ')')} AS BOROUGH, CAST({date('EXPIRES_ON')} AS VARCHAR) AS EXPIRES_ON FROM fitness
    WHERE ordinal <> (SELECT min(ordinal) FROM fitness) AND year({date('EXPIRES_ON')}) > 1997""",
)
def src_fitness_cleaned(t):
    from emberlane.plans.enrich_incidents import current_certificates

    cleaned = current_certificates(t.fitness, 1997, "ordinal")
    return cleaned.select("ordinal", "BOROUGH", F.col("EXPIRES_ON").cast("string").alias("EXPIRES_ON"))


@query(
    "job_partition_by_year",
    f"""SELECT *, CAST(year({moment('INCIDENT_DATETIME')}) AS INT) AS year FROM incidents
    WHERE year({moment('INCIDENT_DATETIME')}) = 2024""",
)
def job_partition_by_year(t):
    return one_year(t.incidents, scratch_path(t.spark, "incidents-by-year"), 2024)


_ONE_YEAR = f"(SELECT * FROM incidents WHERE year({moment('INCIDENT_DATETIME')}) = 2024)"


@query("job_zip_features_one_year", f"WITH one_year AS {_ONE_YEAR}, {ZIP_FEATURES.replace('FROM incidents', 'FROM one_year')} SELECT * FROM zf")
def job_zip_features_one_year(t):
    dispatch = one_year(t.incidents, scratch_path(t.spark, "incidents-by-year"), 2024)
    return zip_features(dispatch, t.inspections, t.fitness, t.violations)


@query(
    "job_catalogues",
    """SELECT DISTINCT 'box' AS kind, ALARM_BOX_NUMBER, ALARM_BOX_BOROUGH, ALARM_BOX_LOCATION, CAST(NULL AS BIGINT) AS BIN,
      CAST(NULL AS BIGINT) AS POSTCODE, CAST(NULL AS VARCHAR) AS BOROUGH, CAST(NULL AS VARCHAR) AS Number,
      CAST(NULL AS VARCHAR) AS Street, CAST(NULL AS DOUBLE) AS LATITUDE, CAST(NULL AS DOUBLE) AS LONGITUDE FROM incidents
    UNION ALL SELECT DISTINCT 'address', NULL, NULL, NULL, BIN, POSTCODE, BOROUGH, Number, Street, LATITUDE, LONGITUDE
    FROM inspections WHERE BIN <> 0""",
)
def job_catalogues(t):
    boxes = box_catalogue(t.incidents, ordered=False).withColumn("kind", F.lit("box"))
    addresses = address_catalogue(t.inspections).withColumn("kind", F.lit("address"))
    return boxes.unionByName(addresses, allowMissingColumns=True)
