"""Fixed values that results depend on; they must stay exactly as given."""

# Incident classifications that count as a false alarm.
FALSE_ALARM_LABELS = ["Alarm System - Defective", "Alarm System - Unnecessary"]

# Incident groups that may involve a fire.
FIRE_GROUPS = ["Structural Fires", "NonStructural Fires", "NonMedical Emergencies", "NonMedical MFAs"]

# Last-inspection statuses.
APPROVED_STATUS = "APPROVAL"
VIOLATION_STATUSES = ["NOT APPROVAL(W/REASON)", "NOT APPROVAL(VIO)"]

# Marks fire-related certificate types.
FIRE_MARK = "FIRE"

# Borough codes and their names.
BOROUGH_NAMES = {
    "MN": "Manhattan",
    "BK": "Brooklyn",
    "SI": "Staten Island",
    "BX": "Bronx",
    "QN": "Queens",
}

# Boroughs of certificate addresses whose borough is blank in the source.
BOROUGH_BY_ADDRESS = {
    "10 GRAND ARMY PLZ": "Brooklyn",
    "1 WORLDS FAIR MARINA": "Queens",
    "21 WEST END AVE": "Manhattan",
    "30-30 THOMPSON AVE": "Queens",
    "254-14 UNION TNPK": "Queens",
    "17-19 HAZEN ST": "Queens",
    "186-16 UNION TNPK": "Queens",
}

# Source date formats: month first, one or two digits, 12-hour clock.
DATE_FORMAT = "M/d/yyyy"
DATETIME_FORMAT = "M/d/yyyy h:mm:ss a"

# Modelling settings: seed, decision threshold, neighbours, trees.
SEED = 1234
THRESHOLD = 0.7
NEIGHBOURS = 5
TREES = 100
