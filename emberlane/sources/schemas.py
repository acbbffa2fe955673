"""Input schemas. Dates stay text here: formats differ by table and bad ones must become NULL, not errors."""

from __future__ import annotations

# Column names and types of the seven input tables (fixed values).
_COLUMNS = {
    "dispatch": """
        STARFIRE_INCIDENT_ID string, INCIDENT_DATETIME string, ALARM_BOX_BOROUGH string, ALARM_BOX_NUMBER string,
        ALARM_BOX_LOCATION string, INCIDENT_BOROUGH string, ZIPCODE int, POLICEPRECINCT int,
        CITYCOUNCILDISTRICT int, COMMUNITYDISTRICT int, COMMUNITYSCHOOLDISTRICT int, CONGRESSIONALDISTRICT int,
        ALARM_SOURCE_DESCRIPTION_TX string, ALARM_LEVEL_INDEX_DESCRIPTION string, HIGHEST_ALARM_LEVEL string,
        INCIDENT_CLASSIFICATION string, INCIDENT_CLASSIFICATION_GROUP string, DISPATCH_RESPONSE_SECONDS_QY int,
        FIRST_ASSIGNMENT_DATETIME string, FIRST_ACTIVATION_DATETIME string, FIRST_ON_SCENE_DATETIME string,
        INCIDENT_CLOSE_DATETIME string, VALID_DISPATCH_RSPNS_TIME_INDC string,
        VALID_INCIDENT_RSPNS_TIME_INDC string, INCIDENT_RESPONSE_SECONDS_QY int, INCIDENT_TRAVEL_TM_SECONDS_QY int,
        ENGINES_ASSIGNED_QUANTITY int, LADDERS_ASSIGNED_QUANTITY int, OTHER_UNITS_ASSIGNED_QUANTITY int""",
    "inspections": """
        ACCT_ID string, ALPHA string, ACCT_NUM string, OWNER_NAME string, LAST_VISIT_DT string,
        LAST_FULL_INSP_DT string, LAST_INSP_STAT string, PREM_ADDR string, BIN bigint, BOROUGH string, POSTCODE int,
        Number string, Street string, LATITUDE double, LONGITUDE double, COMMUNITY_BOARD string,
        COUNCIL_DISTRICT string, BBL string, Census_Tract string, NTA string""",
    "fitness": """
        COF_ID string, COF_NUM string, COF_TYPE string, HOLDER_NAME string, EXPIRES_ON string, PREM_ADDR string,
        BIN bigint, BOROUGH string, POSTCODE int, NUMBER string, STREET string, LATITUDE double, LONGITUDE double,
        COMMUNITY_BOARD string, COUNCIL_DISTRICT string, BBL string, CENSUS_TRACT string, NTA string""",
    "violations": """
        VIO_ID string, ACCT_NUM string, ACCT_OWNER string, VIOLATION_NUM string, VIO_LAW_NUM string,
        VIO_LAW_DESC string, ACTION string, VIO_DATE string, PREM_ADDR string, BIN bigint, BOROUGH string,
        POSTCODE int, NUMBER string, STREET string, LATITUDE double, LONGITUDE double, COMMUNITY_BOARD string,
        COUNCIL_DISTRICT string, BBL string, CENSUS_TRACT string, NTA string""",
    "summary": """
        SUMMARY_ID string, BIN bigint, NUM_SIAM_SPRINKLER string, SPRINKLER_TYPE string, NUM_SIAM_STANDPIPE string,
        STANDPIPE_TYPE string, NUM_OF_VIOLATION_NOTICES int, NUM_OF_VIOLATION_ORDER int, BBL string, BLOCK string,
        LOT string, COMMUNITY_BOARD string, COUNCIL_DISTRICT string""",
    "alarm_box_locations": """
        BOROBOX string, BOX_TYPE string, LOCATION string, ZIP int, BOROUGH string, COMMUNITYDISTICT int,
        CITYCOUNCIL int, LATITUDE double, LONGITUDE double, Location_Point string""",
    "rbis": """
        INSPTN_OPS_DETAIL string, INSPECTING_UNIT_CODE string, INSPTN_TYP_CD string, INSP_INSPECT_DT string,
        BLDG_CURRENT_BIN_FK bigint, BBL string, COMMUNITYDISTRICT int, CITYCOUNCILDISTRICT int, Location_1 string""",
}

# As DDL text, which ``spark.read.schema`` takes.
SCHEMAS: dict[str, str] = {name: " ".join(ddl.split()) for name, ddl in _COLUMNS.items()}
