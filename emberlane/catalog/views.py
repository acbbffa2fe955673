"""The input tables as views over the given star-schema tables.

One definition serves both engines: the few expressions they spell differently
are written as tokens. ``{DT:c}`` / ``{D:c}`` format a time as month-first text
with / without the time of day, ``{S:x}`` casts to text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_BOROUGH_CODE = "CASE {key} % 5 WHEN 0 THEN 'BX' WHEN 1 THEN 'BK' WHEN 2 THEN 'MN' WHEN 3 THEN 'QN' ELSE 'SI' END"
_FULL_BOROUGH = (
    "CASE user_id % 5 WHEN 0 THEN 'BRONX' WHEN 1 THEN 'BROOKLYN' WHEN 2 THEN 'MANHATTAN' WHEN 3 THEN 'QUEENS' "
    "ELSE 'RICHMOND / STATEN ISLAND' END"
)
_ADDRESS = (
    "CASE WHEN o_orderkey % 17 = 4 THEN NULL ELSE CASE o_custkey % 9 WHEN 0 THEN '10 GRAND ARMY PLZ' "
    "WHEN 1 THEN '1 WORLDS FAIR MARINA' WHEN 2 THEN '21 WEST END AVE' WHEN 3 THEN '30-30 THOMPSON AVE' "
    "WHEN 4 THEN '254-14 UNION TNPK' WHEN 5 THEN '17-19 HAZEN ST' WHEN 6 THEN '186-16 UNION TNPK' "
    "ELSE concat({S:o_custkey}, ' MAIN ST') END END"
)

# view -> branches (table, filter, {column: expression}); branches are united.
VIEWS: dict[str, list[tuple[str, str | None, dict[str, str]]]] = {
    "incidents": [
        (
            "events",
            None,
            {
                "STARFIRE_INCIDENT_ID": "event_id",
                "INCIDENT_DATETIME": "{DT:ts}",
                "INCIDENT_CLASSIFICATION": "CASE WHEN user_id % 31 = 3 AND event_id % 5 = 0 THEN NULL "
                "WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Alarm System - Defective' "
                "WHEN event_type = 'signup' AND user_id % 4 = 0 THEN 'Alarm System - Unnecessary' ELSE event_type END",
                "INCIDENT_CLASSIFICATION_GROUP": "CASE event_id % 6 WHEN 0 THEN 'Structural Fires' "
                "WHEN 1 THEN 'NonStructural Fires' WHEN 2 THEN 'NonMedical Emergencies' WHEN 3 THEN 'NonMedical MFAs' "
                "WHEN 4 THEN 'Medical Emergencies' ELSE 'Medical MFAs' END",
                "ALARM_BOX_BOROUGH": _FULL_BOROUGH,
                "ALARM_BOX_NUMBER": "CASE WHEN event_id % 53 = 0 THEN '' ELSE {S:event_id * 37 % 10500} END",
                "ALARM_BOX_LOCATION": "concat('CORNER ', {S:event_id % 11})",
                "INCIDENT_BOROUGH": _FULL_BOROUGH,
                "ZIPCODE": "CASE WHEN user_id % 29 = 7 THEN NULL ELSE 10000 + user_id END",
                "POLICEPRECINCT": "user_id % 77",
            },
        )
    ],
    "inspections": [
        (
            "lineitem",
            None,
            {
                "BIN": "l_partkey",
                "POSTCODE": "CASE WHEN l_partkey % 97 = 5 THEN NULL ELSE 10000 + l_partkey % 150 END",
                "BOROUGH": _BOROUGH_CODE.replace("{key}", "l_partkey"),
                "Number": "{S:l_partkey % 400}",
                "Street": "concat('STREET ', {S:l_partkey % 83})",
                "LATITUDE": "40.5E0 + (l_partkey % 300) / 1024.0E0",
                "LONGITUDE": "-74.0E0 + (l_partkey % 270) / 1024.0E0",
                "ALPHA": "CASE WHEN l_linenumber % 7 = 3 THEN NULL ELSE concat('H', {S:l_linenumber % 4}) END",
                "LAST_INSP_STAT": "CASE WHEN l_partkey % 150 = 11 THEN NULL WHEN l_returnflag = 'A' THEN 'APPROVAL' "
                "WHEN l_returnflag = 'R' THEN 'NOT APPROVAL(VIO)' WHEN l_linestatus = 'O' THEN 'NOT APPROVAL(W/REASON)' "
                "ELSE NULL END",
                "LAST_VISIT_DT": "{D:l_shipdate}",
                "LAST_FULL_INSP_DT": "CASE WHEN l_partkey % 150 = 17 AND l_linenumber = 1 THEN NULL ELSE {D:l_shipdate} END",
                # Text, as the four keys one after the other are too wide for a number that is cheap to make.
                "ordinal": "concat(lpad({S:l_orderkey}, 14, '0'), lpad({S:l_linenumber}, 2, '0'), "
                "lpad({S:l_partkey}, 14, '0'), lpad({S:l_suppkey}, 14, '0'))",
            },
        )
    ],
    "fitness": [
        (
            "orders",
            None,
            {
                "BIN": "o_custkey",
                "POSTCODE": "10000 + o_custkey % 150",
                "BOROUGH": "CASE WHEN o_orderkey % 61 = 0 THEN '' WHEN o_custkey % 2 = 0 THEN 'BK' ELSE 'QN' END",
                "PREM_ADDR": _ADDRESS,
                "COF_TYPE": "CASE o_orderpriority WHEN '1-URGENT' THEN 'FIRE GUARD' WHEN '2-HIGH' THEN 'CITYWIDE FIRE SAFETY' "
                "WHEN '3-MEDIUM' THEN NULL ELSE 'REFRIGERATION' END",
                "EXPIRES_ON": "CASE WHEN o_orderkey % 43 = 0 THEN 'unknown' ELSE {D:o_orderdate} END",
                "ordinal": "o_orderkey",
            },
        )
    ],
    "violations": [
        (
            "orders",
            "o_orderstatus = 'F'",
            {
                "BIN": "o_custkey",
                "POSTCODE": "10000 + o_custkey % 149",
                "BOROUGH": _BOROUGH_CODE.replace("{key}", "o_custkey"),
                "PREM_ADDR": _ADDRESS,
                "VIO_LAW_NUM": "concat('LAW ', {S:o_orderkey % 13})",
                "VIO_LAW_DESC": "CASE WHEN o_orderkey % 13 = 6 THEN NULL ELSE concat('ABOUT ', {S:o_orderkey % 13}) END",
                "ACTION": "o_orderpriority",
                "VIO_DATE": "{D:o_orderdate}",
                "ordinal": "o_orderkey",
            },
        )
    ],
    "summary": [
        (
            "part",
            None,
            {
                "BIN": "p_partkey",
                "NUM_SIAM_SPRINKLER": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE concat({S:p_size}, ';', {S:p_size % 7}, ';x') END",
                "SPRINKLER_TYPE": "p_type",
                "NUM_SIAM_STANDPIPE": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE {S:p_size} END",
                "STANDPIPE_TYPE": "p_brand",
                "NUM_OF_VIOLATION_NOTICES": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 6 END",
                "NUM_OF_VIOLATION_ORDER": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size % 3 END",
            },
        ),
        # Buildings listed a second time.
        (
            "part",
            "p_size <= 5",
            {
                "BIN": "p_partkey",
                "NUM_SIAM_SPRINKLER": "'2'",
                "SPRINKLER_TYPE": "p_type",
                "NUM_SIAM_STANDPIPE": "'1'",
                "STANDPIPE_TYPE": "p_brand",
                "NUM_OF_VIOLATION_NOTICES": "1",
                "NUM_OF_VIOLATION_ORDER": "0",
            },
        ),
    ],
    "boxes": [
        (
            "supplier",
            None,
            {
                "BOROBOX": "concat('B', lpad({S:s_suppkey}, 4, '0'))",
                "LOCATION": "s_name",
                "BOROUGH": "CASE s_nationkey % 3 WHEN 0 THEN 'Brooklyn' WHEN 1 THEN 'Bronx' ELSE NULL END",
                "ZIP": "10000 + s_suppkey",
                "COMMUNITYDISTICT": "s_nationkey",
                "ordinal": "2 * s_suppkey",
            },
        ),
        # The same number again under another borough letter.
        (
            "supplier",
            "s_acctbal < 3000",
            {
                "BOROBOX": "concat('X', lpad({S:s_suppkey}, 4, '0'))",
                "LOCATION": "'duplicate box'",
                "BOROUGH": "'Bronx'",
                "ZIP": "CAST(NULL AS BIGINT)",
                "COMMUNITYDISTICT": "CAST(NULL AS INT)",
                "ordinal": "2 * s_suppkey + 1",
            },
        ),
    ],
}

_SPARK_FORMS = {
    "DT": "date_format(CAST({0} AS TIMESTAMP), 'MM/dd/yyyy hh:mm:ss a')",
    "D": "date_format(CAST({0} AS TIMESTAMP), 'MM/dd/yyyy')",
    "S": "CAST({0} AS STRING)",
}
_DUCKDB_FORMS = {
    "DT": "strftime({0}, '%m/%d/%Y %I:%M:%S %p')",
    "D": "strftime({0}, '%m/%d/%Y')",
    "S": "CAST({0} AS VARCHAR)",
}


def _expand(expression: str, forms: dict[str, str]) -> str:
    return re.sub(r"\{(DT|D|S):([^{}]*)\}", lambda m: forms[m[1]].format(m[2]), expression)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    branches = []
    for table, where, columns in VIEWS[name]:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        df = df.where(where) if where else df
        branches.append(df.selectExpr(*[f"{_expand(e, _SPARK_FORMS)} AS `{c}`" for c, e in columns.items()]))
    return reduce(DataFrame.unionByName, branches)


def view_sql(name: str) -> str:
    branches = []
    for table, where, columns in VIEWS[name]:
        fields = ", ".join(f"{_expand(e, _DUCKDB_FORMS)} AS {c}" for c, e in columns.items())
        branches.append(f"SELECT {fields} FROM {table}" + (f" WHERE {where}" if where else ""))
    return " UNION ALL ".join(branches)


class Tables:
    """The views of one data folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return view(self.spark, self.sf_dir, name)
