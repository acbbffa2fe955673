"""How five document filters interact: what each step of every order removes, and each filter's Shapley share.

A document is one of 32 sets of failed filters. From the number of documents of each set come the removals of all 32
coalitions of filters; every step of every order is a difference of two coalitions, and the Shapley values solve a least
squares problem over the coalitions, weighted by the Shapley kernel and held to add up to the removals of all filters.
It is solved in rationals, so nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberlane.llm.common import whole_text

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_failures(text: Column) -> dict[str, Column]:
    """The four conditions that a text alone decides: true where the filter throws the document out."""
    # An array of words that are cut at white space; an empty one stands before and after.
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    n_upper = F.char_length(text) - F.char_length(F.translate(text, _UPPER, ""))
    return {
        "A": n_words < 50,
        "B": 100 * n_distinct < 65 * n_words,
        "C": 100 * n_upper.cast("bigint") > 5 * F.char_length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) of every document; bit k of ``failed`` stands for filter k.

    Texts are read and left where they are: what is shuffled is a digest, an id, the part and four bits. The first document of a
    text is found by an aggregate, which reduces a group of copies within each task, and marked by a join on digest and id, in
    which the copies of one text are spread by their ids.
    """
    text = whole_text("text")
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(text).values())), F.lit(0))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("content"),
        bits.alias("bits"),
    )
    first = rows.filter("id is not null").groupBy("content").agg(F.min("id").alias("first_id")).withColumnRenamed("content", "first_content")
    same = (F.col("content") == F.col("first_content")) & (F.col("id") == F.col("first_id"))
    repeated = F.when(F.col("first_id").isNull() & F.col("id").isNotNull(), SETS >> 1).otherwise(0)
    marked = rows.join(first, same, "left").select("id", "part", (F.col("bits") + repeated).alias("failed"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.coalesce(F.col("quality") == 1, F.lit(False))).cast("int")).alias("good"),
        F.max((F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("toxic"),
    )
    return marked.join(known, "id", "left").select(
        "part", "failed", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )


def coalition_removals(failed: DataFrame) -> DataFrame:
    """One row per part: n documents, and for each of the 32 coalitions how many documents, good and toxic ones it removes."""
    counted = failed.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def removals(name: str) -> Column:
        caught = lambda s: F.when(F.col("failed").bitwiseAND(F.lit(s)) != 0, F.col(name)).otherwise(F.lit(0))
        return F.array(*[F.sum(caught(s)).cast("bigint") for s in range(SETS)]).alias(name)

    return counted.groupBy("part").agg(F.sum("n").alias("rows"), removals("n"), removals("good"), removals("toxic"))


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system, by elimination."""
    rows = [[*line, value] for line, value in zip(matrix, right, strict=True)]
    for k in range(len(rows)):
        pivot = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i, line in enumerate(rows):
            if i != k and line[k]:
                rows[i] = [x - line[k] * y for x, y in zip(line, rows[k], strict=True)]
    return [line[-1] for line in rows]


def shapley_values(worth: list[int], players: int = len(FILTERS)) -> list[Fraction]:
    """Shapley values of a game given by the worth of each coalition (a bit for each player; the empty one has worth 0).

    They minimise the sum over coalitions S, neither empty nor whole, of k(S) * (worth(S) - sum of the values in S)**2 under
    the condition that all values add up to the whole's worth, with k(S) = (M - 1) / (C(M, |S|) * |S| * (M - |S|)).
    """
    whole = (1 << players) - 1
    normal = [[Fraction(0)] * (players + 1) for _ in range(players + 1)]
    right = [Fraction(0)] * (players + 1)
    for s in range(1, whole):
        inside = [i for i in range(players) if s >> i & 1]
        weight = Fraction(players - 1, comb(players, len(inside)) * len(inside) * (players - len(inside)))
        for i in inside:
            right[i] += weight * worth[s]
            for j in inside:
                normal[i][j] += weight
    # The last row and column are the condition and its multiplier.
    for i in range(players):
        normal[i][players] = normal[players][i] = Fraction(1)
    right[players] = Fraction(worth[whole])
    return solve(normal, right)[:players]


def audit_rows(part: str, rows: int, removed: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    """All orders and steps of one part, from the removals of the coalitions."""
    values = shapley_values(removed)
    whole = SETS - 1
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            here = removed[after] - removed[before]
            yield (
                part, name, step, rows - removed[after], here, removed[1 << k] - here, removed[whole] - removed[whole ^ 1 << k],
                good[after] - good[before], toxic[after] - toxic[before], int(values[k] * factorial(len(FILTERS))),
            )
            before = after


def _audit(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                found = list(audit_rows(part["part"], part["rows"], part["n"], part["good"], part["toxic"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return run


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), order of the five filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (the filter's removals summed over all orders).

    Null text counts as empty, a null source as the empty string. A null id is neither smaller nor larger than another, so its
    row never fails E and makes no other row fail; rows that share both id and text do not fail by each other. A document with
    several label rows is good or toxic if one of them says so; label rows without a document count nowhere. Parts are as
    many as there are sources, and each gives 600 rows in the task that holds its counts. An empty table gives no rows. Other
    columns are not read.
    """
    removals = coalition_removals(failed_sets(docs, labels))
    return removals.mapInArrow(_audit(to_arrow_schema(StructType.fromDDL(_RESULT))), _RESULT)


#: The same rows from the orders themselves: each step counts the documents that fail its filter and none before.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END,
      CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS f
  FROM words LEFT JOIN known ON words.doc_id = known.doc_id),
counted AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT concat(a.l, b.l, c.l, d.l, e.l) AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, CAST(i AS INTEGER) AS step, substring(o, i, 1) AS filter, substring(o, 1, i - 1) AS earlier, substring(o, 1, i) AS upto
  FROM orders, range(1, 6) r(i)),
tried AS (SELECT part, o, step, filter, f, n, good, toxic, contains(f, filter) AS fails_here,
    regexp_matches(f, concat('[_', earlier, ']')) AS gone, regexp_matches(f, concat('[', upto, ']')) AS gone_after FROM counted, steps),
summed AS (SELECT part, o AS filter_order, step, filter,
    coalesce(sum(n) FILTER (WHERE NOT gone_after), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE fails_here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE fails_here AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE f = filter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails_here AND NOT gone), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE fails_here AND NOT gone), 0) AS toxic_lost FROM tried GROUP BY part, o, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM summed
"""
