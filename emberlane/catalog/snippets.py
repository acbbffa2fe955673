"""SQL pieces the DuckDB counterparts share."""

from __future__ import annotations

from collections.abc import Iterable

from emberlane.functions import constants


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Iterable[str]) -> str:
    return f"({', '.join(quoted(v) for v in values)})"


def looked_up(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in table.items())}"


def date(text: str) -> str:
    return f"CAST(try_strptime({text}, '%m/%d/%Y') AS DATE)"


def day(text: str) -> str:
    return f"date_diff('day', DATE '1970-01-01', {date(text)})"


def moment(text: str) -> str:
    return f"try_strptime({text}, '%m/%d/%Y %I:%M:%S %p')"


IS_FALSE_ALARM = f"INCIDENT_CLASSIFICATION IN {listed(constants.FALSE_ALARM_LABELS)}"
FALSE_ALARM = f"CASE WHEN {IS_FALSE_ALARM} THEN 1 WHEN INCIDENT_CLASSIFICATION IS NOT NULL THEN 0 END"
FALSE_ALARM_OR_ZERO = f"CASE WHEN {IS_FALSE_ALARM} THEN 1 ELSE 0 END"
FIRE_GROUPS = listed(constants.FIRE_GROUPS)
PADDED_BOX = "CASE WHEN length(ALARM_BOX_NUMBER) BETWEEN 1 AND 4 THEN lpad(ALARM_BOX_NUMBER, 4, '0') END"


def recoded(column: str) -> str:
    return f"{looked_up(column, constants.BOROUGH_NAMES)} ELSE {column} END"


CORRECTED_BOROUGH = (
    f"CASE WHEN BOROUGH = '' THEN coalesce({looked_up('PREM_ADDR', constants.BOROUGH_BY_ADDRESS)} END, BOROUGH) ELSE BOROUGH END"
)


def split_sum(text: str) -> str:
    return (
        f"CASE WHEN {text} IS NOT NULL THEN coalesce((SELECT sum(try_cast(u.part AS DOUBLE)) "
        f"FROM (SELECT unnest(string_split({text}, ';')) AS part) u), 0.0) END"
    )


# Zip features as a chain of common table expressions, the last one named zf.
ZIP_FEATURES = f"""
fa AS (SELECT ZIPCODE, CASE WHEN count(*) = count(f) THEN CAST(sum(f) AS BIGINT) END AS number_of_false_alarms
       FROM (SELECT ZIPCODE, {FALSE_ALARM} AS f FROM incidents) GROUP BY ZIPCODE),
ins AS (SELECT POSTCODE,
          count(*) FILTER (WHERE LAST_INSP_STAT IN ('NOT APPROVAL(W/REASON)', 'NOT APPROVAL(VIO)')) AS last_inspection_status_vio,
          CASE WHEN count(*) = count({day('LAST_FULL_INSP_DT')}) THEN median({day('LAST_FULL_INSP_DT')}) END AS m_insp
        FROM inspections GROUP BY POSTCODE),
app AS (SELECT POSTCODE, count(*) FILTER (WHERE LAST_INSP_STAT = 'APPROVAL') / nullif(count(LAST_INSP_STAT), 0) AS proportion_approved
        FROM inspections WHERE BIN <> 0 GROUP BY POSTCODE),
cert AS (SELECT POSTCODE, median({day('EXPIRES_ON')}) AS m_cert FROM fitness WHERE contains(COF_TYPE, 'FIRE') GROUP BY POSTCODE),
vio AS (SELECT POSTCODE, median({day('VIO_DATE')}) AS m_vio FROM violations GROUP BY POSTCODE),
j AS (SELECT fa.*, last_inspection_status_vio, m_insp, m_cert, m_vio FROM fa
      LEFT JOIN ins ON fa.ZIPCODE IS NOT DISTINCT FROM ins.POSTCODE
      LEFT JOIN cert ON fa.ZIPCODE IS NOT DISTINCT FROM cert.POSTCODE
      LEFT JOIN vio ON fa.ZIPCODE IS NOT DISTINCT FROM vio.POSTCODE),
c AS (SELECT ZIPCODE, number_of_false_alarms, last_inspection_status_vio,
        m_cert - (SELECT median(m_cert) FROM j) AS days_from_median_cert_expiry_date,
        m_insp - (SELECT median(m_insp) FROM j) AS days_from_median_last_full_inspection_date,
        m_vio - (SELECT median(m_vio) FROM j) AS days_from_median_violation_date FROM j),
cc AS (SELECT * FROM c WHERE ZIPCODE IS NOT NULL AND number_of_false_alarms IS NOT NULL AND last_inspection_status_vio IS NOT NULL
       AND days_from_median_cert_expiry_date IS NOT NULL AND days_from_median_last_full_inspection_date IS NOT NULL
       AND days_from_median_violation_date IS NOT NULL),
zf AS (SELECT cc.*, CASE WHEN number_of_false_alarms < (SELECT median(number_of_false_alarms) FROM cc) THEN 0 ELSE 1 END
         AS false_alarms_above_below_median, proportion_approved
       FROM cc LEFT JOIN app ON cc.ZIPCODE = app.POSTCODE)"""


def split(source: str, key: str) -> str:
    """Rows of ``source`` with the exact split by hash order."""
    return (
        f"SELECT *, CASE WHEN rn <= ceil(n * 0.5) THEN 'train' WHEN rn <= ceil(n * 0.5) + ceil(n * 0.25) THEN 'validate' "
        f"ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('1234:', CAST({key} AS VARCHAR)))) AS rn, "
        f"count(*) OVER () AS n FROM {source})"
    )


FEATURE_NAMES = [
    "last_inspection_status_vio",
    "days_from_median_cert_expiry_date",
    "days_from_median_last_full_inspection_date",
    "days_from_median_violation_date",
    "proportion_approved",
]


def nearest(train: str, query: str, k: int = 5) -> str:
    """Majority label of the k nearest train rows for each query row with all features."""
    gaps = " + ".join(f"(CAST(q.{f} AS DOUBLE) - t.{f}) * (CAST(q.{f} AS DOUBLE) - t.{f})" for f in FEATURE_NAMES)
    known = lambda a: " AND ".join(f"{a}.{f} IS NOT NULL" for f in FEATURE_NAMES)
    return (
        f"SELECT ZIPCODE, CASE WHEN 2 * sum(label) > count(*) THEN 1 ELSE 0 END AS prediction FROM ("
        f"SELECT q.ZIPCODE, t.false_alarms_above_below_median AS label, "
        f"row_number() OVER (PARTITION BY q.ZIPCODE ORDER BY {gaps}, t.ZIPCODE) AS rk "
        f"FROM {query} q, {train} t WHERE {known('q')} AND {known('t')}) WHERE rk <= {k} GROUP BY ZIPCODE"
    )


# Incidents scored by their zip's share of false alarms, with a hard prediction.
SCORED = f"""
flagged AS (SELECT STARFIRE_INCIDENT_ID, ZIPCODE, {FALSE_ALARM} AS truth FROM incidents WHERE INCIDENT_CLASSIFICATION IS NOT NULL),
rates AS (SELECT ZIPCODE, avg(truth) AS score FROM flagged GROUP BY ZIPCODE),
scored AS (SELECT f.*, score, CASE WHEN score > (SELECT avg(truth) FROM flagged) THEN 1 ELSE 0 END AS prediction
           FROM flagged f JOIN rates r ON f.ZIPCODE IS NOT DISTINCT FROM r.ZIPCODE)"""

# Incidents with their time factors and their zip's features, none of them NULL.
LABELLED_INCIDENTS = f"""
timed AS (SELECT *, {FALSE_ALARM} AS false_alarm, {moment('INCIDENT_DATETIME')} AS happened FROM incidents),
labelled AS (SELECT STARFIRE_INCIDENT_ID, ZIPCODE, false_alarm, dayname(happened) AS incident_weekday, CAST(hour(happened) AS VARCHAR) AS incident_hour,
    CAST(month(happened) AS VARCHAR) AS incident_month, {', '.join(FEATURE_NAMES)} FROM timed JOIN zf USING (ZIPCODE)
  WHERE STARFIRE_INCIDENT_ID IS NOT NULL AND false_alarm IS NOT NULL AND happened IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in FEATURE_NAMES)})"""

# Fire-related incidents in the zips that ``near`` predicts above the median, with their zip's features; needs zf and near.
FOCUS_INCIDENTS = f"""
focus AS (SELECT zf.* FROM zf JOIN near USING (ZIPCODE) WHERE prediction = 1),
fire AS (SELECT STARFIRE_INCIDENT_ID, ZIPCODE, {PADDED_BOX} AS ALARM_BOX_NUMBER, false_alarm, dayname(happened) AS incident_weekday,
    CAST(hour(happened) AS VARCHAR) AS incident_hour, monthname(happened) AS incident_month, {', '.join(FEATURE_NAMES)}
  FROM (SELECT *, {FALSE_ALARM} AS false_alarm, {moment('INCIDENT_DATETIME')} AS happened FROM incidents) JOIN focus USING (ZIPCODE)
  WHERE INCIDENT_CLASSIFICATION_GROUP IN {FIRE_GROUPS} AND STARFIRE_INCIDENT_ID IS NOT NULL AND {PADDED_BOX} IS NOT NULL
    AND false_alarm IS NOT NULL AND happened IS NOT NULL)"""


def forest(train: str, query: str, key: str, outcome: str, numeric: list[str], factors: list[str] = (), weights=(1, 10), balanced=False, prefix="f") -> str:
    """Tables of a forest: ``{prefix}_draws`` and, for the rows of ``query``, ``{prefix}_scores`` (the key and a probability).

    The trees are not kept: rows of both tables go down all trees together, drawn rows with the number of their draws, asked rows
    with none, until their node is split no more.
    """
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*numeric, *factors])
    codes = [f"(SELECT list_sort(list(DISTINCT {c})) FROM {train} WHERE {complete} AND {outcome} IS NOT NULL) AS v_{c}" for c in factors]
    x = [f"CAST({c} AS DOUBLE)" for c in numeric] + [f"CAST(list_position(v_{c}, {c}) AS DOUBLE)" for c in factors]
    rows = lambda t: f"{t}{', (SELECT ' + ', '.join(codes) + ') lv' if codes else ''} WHERE {complete}"
    tried = int(len(x) ** 0.5)
    part = lambda a, b: f"(CAST({weights[0]} * {a} * {a} + {weights[1]} * {b} * {b} AS DOUBLE) / CAST({a} + {b} AS DOUBLE))"
    p = prefix
    return f"""
{p}_rows AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(concat('1234:', CAST(id AS VARCHAR)))) - 1 AS rn,
    count(*) OVER (PARTITION BY s) AS size, count(*) OVER () AS n
  FROM (SELECT {key} AS id, CAST({outcome} AS INTEGER) AS y, {'CAST(' + outcome + ' AS INTEGER)' if balanced else '0'} AS s, [{', '.join(x)}] AS x
    FROM {rows(train)} AND {outcome} IS NOT NULL)),
{p}_draws AS (SELECT tree, s, rn, count(*) AS m FROM (
    SELECT tree, s, CAST(floor(CAST(concat('0x', substring(md5(concat('1234:', tree, ':', s, ':', j)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE * size) AS BIGINT) AS rn
    FROM (SELECT tree, s, size, unnest(range(k)) AS j FROM (SELECT DISTINCT s, size, {'n // 2' if balanced else 'n'} AS k FROM {p}_rows), range(100) t(tree)))
  GROUP BY tree, s, rn),
{p}_all AS (SELECT tree, id, y, m, x FROM {p}_draws JOIN {p}_rows USING (s, rn)
  UNION ALL SELECT tree, {key} AS id, -1 AS y, 0 AS m, [{', '.join(x)}] AS x FROM (SELECT * FROM {rows(query)}), range(100) t(tree)),
{p}_walk AS (
  SELECT tree, CAST(1 AS BIGINT) AS node, 0 AS depth, id, y, m, x FROM {p}_all
  UNION ALL
  SELECT r.tree, 2 * r.node + CASE WHEN r.x[b.f] > b.cut THEN 1 ELSE 0 END, r.depth + 1, r.id, r.y, r.m, r.x
  FROM {p}_walk r JOIN (
    SELECT tree, node, f, CASE WHEN (v + nv) / 2 < nv THEN (v + nv) / 2 ELSE v END AS cut FROM (
      SELECT *, n0 - l0 AS r0, n1 - l1 AS r1 FROM (
        SELECT *, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, lead(v) OVER w AS nv FROM (
          SELECT t.tree, t.node, t.f, n0, n1, r.x[t.f] AS v, coalesce(sum(m) FILTER (WHERE y = 0), 0) AS c0, coalesce(sum(m) FILTER (WHERE y = 1), 0) AS c1
          FROM (SELECT tree, node, n0, n1, f FROM (
              SELECT tree, node, sum(m) FILTER (WHERE y = 0) AS n0, sum(m) FILTER (WHERE y = 1) AS n1 FROM {p}_walk
              WHERE m > 0 AND depth < 30 GROUP BY tree, node HAVING n0 > 0 AND n1 > 0 AND n0 + n1 > 10) nodes, range(1, {len(x) + 1}) features(f)
            QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY md5(concat('1234:', tree, ':', node, ':', f - 1))) <= {tried}) t
          JOIN {p}_walk r ON r.tree = t.tree AND r.node = t.node AND r.m > 0 GROUP BY t.tree, t.node, t.f, n0, n1, v)
        WINDOW w AS (PARTITION BY tree, node, f ORDER BY v))
      WHERE nv IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {part('l0', 'l1')} + {part('r0', 'r1')} DESC, f, v) = 1) b
  ON r.tree = b.tree AND r.node = b.node),
{p}_leaves AS (SELECT tree, id, y, m, max_by(node, depth) AS leaf FROM {p}_walk GROUP BY tree, id, y, m),
{p}_shares AS (SELECT tree, leaf, sum(m * y) / sum(m) AS share FROM {p}_leaves WHERE m > 0 GROUP BY tree, leaf),
{p}_scores AS (SELECT id AS {key}, avg(share) AS probability FROM {p}_leaves JOIN {p}_shares USING (tree, leaf) WHERE m = 0 GROUP BY id)"""


def logistic(train: str, outcome: str, numeric: list[str], factors: list[str] = (), weight: str = "1.0", prefix: str = "g") -> str:
    """Tables of a logistic model: ``{prefix}_terms`` (term, estimate), and ``{prefix}_fit`` with the levels and coefficients that
    ``link`` reads. Twelve Newton steps from zero; each solves the normal equations, a list of rows, by elimination.
    """
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [outcome, *numeric, *factors])
    p = prefix
    levels = "".join(f", (SELECT list_sort(list(DISTINCT {c})) FROM {train} WHERE {complete}) AS v_{c}" for c in factors)
    names = " || ".join(["['(Intercept)']", *[f"list_transform(v_{c}[2:], lambda l: concat('{c}_', l))" for c in factors], str(numeric)])
    return f"""
{p}_levels AS (SELECT 1 AS one{levels}),
{p}_rows AS (SELECT CAST({outcome} AS DOUBLE) AS y, CAST({weight} AS DOUBLE) AS w, {_design(numeric, factors)} AS x FROM {train}, {p}_levels WHERE {complete}),
{p}_size AS (SELECT max(len(x)) AS size FROM {p}_rows),
{p}_newton AS (
  SELECT 0 AS k, list_transform(range(size), lambda i: CAST(0 AS DOUBLE)) AS beta FROM {p}_size
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: r[len(r)] + beta[i]) FROM (
    SELECT k, beta, list_reduce(list_prepend(m, list_transform(range(1, len(m) + 1), lambda c: [[CAST(c AS DOUBLE)]])),
      lambda a, c: list_transform(a, lambda r, i: CASE WHEN i = c[1][1] THEN list_transform(r, lambda v: v / r[i])
        ELSE list_transform(r, lambda v, j: v - r[CAST(c[1][1] AS INTEGER)] * a[CAST(c[1][1] AS INTEGER)][j] / a[CAST(c[1][1] AS INTEGER)][CAST(c[1][1] AS INTEGER)]) END)) AS m
    FROM (SELECT k, beta, list(line ORDER BY i) AS m FROM (
      SELECT k, beta, i, list(h ORDER BY j) AS line FROM (
        SELECT k, beta, i, j, sum(CASE WHEN j <= size THEN w * q * (1 - q) * x[i] * x[j] ELSE w * (y - q) * x[i] END) AS h
        FROM (SELECT k, beta, x, y, w, size, 1 / (1 + exp(-list_dot_product(x, beta))) AS q FROM {p}_newton, {p}_rows, {p}_size WHERE k < 12) fitted,
          (SELECT unnest(range(1, size + 1)) AS i FROM {p}_size) a, (SELECT unnest(range(1, size + 2)) AS j FROM {p}_size) b
        GROUP BY k, beta, i, j) GROUP BY k, beta, i) GROUP BY k, beta))),
{p}_fit AS (SELECT * FROM {p}_newton, {p}_levels WHERE k = 12),
{p}_terms AS (SELECT unnest({names}) AS term, unnest(beta) AS estimate FROM {p}_fit)"""


def _design(numeric: list[str], factors: list[str]) -> str:
    dummies = [f"list_transform(v_{c}[2:], lambda l: CASE WHEN {c} = l THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for c in factors]
    return " || ".join(["[1.0::DOUBLE]", *dummies, "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in numeric) + "]"])


def link(numeric: list[str], factors: list[str] = ()) -> str:
    """The log-odds of a row that stands beside ``{prefix}_fit``; NULL if a feature is missing or a level is not known."""
    known = " AND ".join([*(f"{c} IS NOT NULL" for c in numeric), *(f"coalesce(list_contains(v_{c}, {c}), false)" for c in factors)])
    return f"CASE WHEN {known} THEN list_dot_product({_design(numeric, factors)}, beta) END"
