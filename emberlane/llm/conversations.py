"""Damage to conversations, and its cheapest repair by Hirschberg's divide and conquer.

A conversation becomes a line of codes, one byte for each row: the row's role initial and its first fault. A repair walks an
automaton of four states (nothing written yet, after a system turn, after a user turn, after an assistant turn) that accepts an
optional system turn and pairs of user and assistant. Instead of a table of all rows and states, the solver keeps one vector
of four costs from the left and one from the right; they meet in the middle of the conversation, the crossing state with the least
audit among the cheapest ones is chosen, and both halves are solved the same way, so memory grows with the rows by a byte each.

Texts never meet in one place: the codes are gathered per conversation (the audit, one letter for each edit, is as long), and
the repaired text is hashed as its rows stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberlane.session import materialise

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: States in which a conversation may end: nothing at all, or after an assistant turn.
ENDS = (START, ASSISTANT)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60

# Costs of the edits, and their letters, in ASCII order of the letters.
DELETE, INSERT, KEEP, REROLE = "DIKR"
_DELETED, _INSERTED, _REROLED, _CUT_OFF = 3, 2, 2, 1

# A row's code: its initial (0: another letter or none, 1: s, 2: u, 3: a) plus 4 times its fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _next(state: int, initial: int) -> int | None:
    """The state after writing a turn of that role, if one may follow."""
    allowed = (initial == SYSTEM and state == START) or (initial == USER and state != USER) or (initial == ASSISTANT and state == USER)
    return initial if allowed else None


def _insertions() -> list[list[int]]:
    """How many inserted turns lead from one state to another at least; the states between are settled by the two."""
    steps = [[FAR] * STATES for _ in range(STATES)]
    for state in range(STATES):
        at, n = state, 0
        while steps[state][at] == FAR:
            steps[state][at] = n
            at, n = (ASSISTANT if at == USER else USER), n + 1
    return steps


_STEPS = _insertions()


def _moves(code: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of every way to deal with one row: turns inserted before it, then its own edit."""
    initial, fault = code & 3, code >> 2
    found = []
    for state in range(STATES):
        for between in range(STATES):
            n = _STEPS[state][between]
            if n == FAR:
                continue
            ahead, cost = INSERT * n, _INSERTED * n
            found.append((state, between, cost + _DELETED, ahead + DELETE))
            if fault in (BLANK, DUPLICATE):
                continue
            cost += _CUT_OFF if fault == TRUNCATED else 0
            if initial and (to := _next(between, initial)) is not None:
                found.append((state, to, cost, ahead + KEEP))
            for role in (USER, ASSISTANT):
                if (to := _next(between, role)) is not None:
                    found.append((state, to, cost + _REROLED, ahead + REROLE))
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for a, b, cost, letters in found:
        best[a, b] = min(best.get((a, b), (FAR, "")), (cost, letters))
    return [(a, b, cost, letters) for (a, b), (cost, letters) in sorted(best.items())]


#: By code: how a row may be dealt with. No row's letters are the beginning of another way's, as each ends with its one
#: letter that is no insertion; so audits of equally many rows compare by their first difference.
MOVES = [_moves(code) for code in range(16)]


def _ranked(found: list[tuple]) -> list[tuple[int, int]]:
    """(cost, place of the audit among the four) for each state from (cost, key of the audit)."""
    keys = sorted({key for cost, key in found if cost < FAR})
    return [(cost, keys.index(key)) if cost < FAR else (FAR, 0) for cost, key in found]


def forward(codes: bytes, start: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each state the least cost to be in it after ``codes``, and the place of its least audit among the states'."""
    vector = start
    for code in codes:
        found: list[tuple] = [(FAR, ())] * STATES
        for a, b, cost, letters in MOVES[code]:
            before, place = vector[a]
            if before < FAR:
                found[b] = min(found[b], (before + cost, (place, letters)))
        vector = _ranked(found)
    return vector


def backward(codes: bytes, end: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each state the least cost to get from it over ``codes`` to the end, and the place of its least audit."""
    vector = end
    for code in reversed(codes):
        found: list[tuple] = [(FAR, ())] * STATES
        for a, b, cost, letters in MOVES[code]:
            after, place = vector[b]
            if after < FAR:
                found[a] = min(found[a], (after + cost, (letters, place)))
        vector = _ranked(found)
    return vector


def _at(state: int) -> list[tuple[int, int]]:
    return [(0, 0) if s == state else (FAR, 0) for s in range(STATES)]


def _crossings(codes: bytes, first: int, last: int) -> Iterator[str]:
    """The letters of the cheapest, audit-least way from state ``first`` to state ``last``, row by row."""
    # An own stack, as a conversation may be long: (low, high, state before, state after), the leftmost part on top.
    parts = [(0, len(codes), first, last)]
    while parts:
        low, high, a, b = parts.pop()
        if high - low == 1:
            yield next(letters for x, y, _, letters in MOVES[codes[low]] if (x, y) == (a, b))
            continue
        middle = (low + high) // 2
        left, right = forward(codes[low:middle], _at(a)), backward(codes[middle:high], _at(b))
        # Audits of the left half decide first: none of them is the beginning of another.
        ways = [(left[s][0] + right[s][0], left[s][1], right[s][1], s) for s in range(STATES) if left[s][0] < FAR and right[s][0] < FAR]
        state = min(ways)[3]
        parts += [(middle, high, state, b), (low, middle, a, state)]


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, of equally cheap ones those whose letters come first in ASCII order."""
    # What is inserted after the last row: a shorter audit comes before a longer one that begins with it.
    tail = {s: min((_STEPS[s][e], e) for e in ENDS) for s in range(STATES)}
    end = [(_INSERTED * tail[s][0], tail[s][0]) for s in range(STATES)]
    if not codes:
        return 0, ""
    reached = forward(codes, _at(START))
    cost, _, n, last = min((reached[s][0] + end[s][0], reached[s][1], end[s][1], s) for s in range(STATES) if reached[s][0] < FAR)
    return cost, "".join(_crossings(codes, START, last)) + INSERT * n


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage; a repeated row stands there twice.

    What happens to a row is settled by crc32 of ``conv_id:turn`` modulo 20: 0 drops it, 1 empties its text, 2 takes out of it all
    of ``.!?``, 3 repeats it, 4 makes it the user's. A null id, turn, role or text counts as one space there; the id and the turn
    themselves stay null.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    named = rows.select("conv_id", "turn", spaced("role").alias("role"), "text", kind.alias("_kind")).filter("_kind != 0")
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mark, code, n, first): equal rows of a turn as one, ``first`` if no earlier row has their role and text.

    ``mark`` is a digest of role and text. Equal rows are counted within each task before they are shuffled, and the first turn of a
    mark is found by an aggregate, so neither a turn nor a text that fills a conversation gathers its rows.
    """
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    cells = rows.groupBy("conv_id", "turn", "role", _mark().alias("mark"), (letter + 4 * fault).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = cells.groupBy(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark")).agg(F.min(order).alias("_order"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("mark") == F.col("_mark")) & (order == F.col("_order"))
    return cells.join(firsts, same, "left").withColumn("first", F.col("_mark").isNotNull()).drop("_conv", "_mark", "_order")


def _mark():
    return F.unhex(F.sha2(F.concat("role", F.lit(":"), "text"), 256))


_AUDIT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _conversation(rows: Iterator[dict]) -> tuple:
    """The audit of one conversation from its cells in order; holds a byte for each row."""
    codes, counts, illegal, last = bytearray(), [0] * 4, 0, None
    low = high = before = None
    turns = 0
    for cell in rows:
        turn, initial, fault, n = cell["turn"], cell["code"] & 3, cell["code"] >> 2, cell["n"]
        if turn is not None:
            if turn != before:
                turns += 1
            low, high, before = (turn if low is None else low), turn, turn
        head = fault if fault == BLANK or cell["first"] else DUPLICATE
        rest = BLANK if fault == BLANK else DUPLICATE
        codes += bytes([initial + 4 * head]) + bytes([initial + 4 * rest]) * (n - 1)
        counts[head] += 1
        counts[rest] += n - 1
        illegal += (last is not None and (last, initial) not in _LEGAL) + (n - 1 if (initial, initial) not in _LEGAL else 0)
        last = initial
    cost, audit = repair(bytes(codes))
    gaps = 0 if low is None else high - low + 1 - turns
    return gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, audit


def _rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[dict]:
    """One row after the other, converted ``least`` at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, least):
            yield from batch.slice(start, least).to_pylist()


def _by_conversation(rows: Iterator[dict]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv_id, its rows) of rows sorted by it; each conversation is read to its end before the next one."""
    import itertools

    return itertools.groupby(rows, key=lambda row: row["conv_id"])


def _batched(found: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in found:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _audits(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((name, *_conversation(c for c in cells if c["n"])) for name, cells in _by_conversation(_rows(batches, 10_000)))
        yield from _batched(found, schema)

    return run


def repaired_turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired conversation: ``audit`` applied to (role, text) in order."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == INSERT else next(rows)
        if letter == DELETE:
            continue
        if letter == KEEP:
            state = _INITIALS[role[:1]]
        else:
            state = ASSISTANT if state == USER else USER
            role = _NAMES[state]
        yield role, text


def _hashes(schema: pa.Schema):
    def one(name, rows: Iterator[dict]) -> tuple:
        head = next(rows)
        digest, written = hashlib.sha256(), False
        for role, text in repaired_turns(head["audit"], ((r["role"], r["text"]) for r in rows for _ in range(r["n"]))):
            digest.update(f"{chr(10) if written else ''}{role}:{text}".encode())
            written = True
        return (name, *(head[f.name] for f in list(schema)[1:-1]), digest.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (one(name, rows) for name, rows in _by_conversation(_rows(batches, 500)))
        yield from _batched(found, schema)

    return run


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Per conversation, also one that damage leaves without rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows are damaged first (see ``damage``), then read by turn, nulls first; rows of one turn by role and then by a digest of role
    and text, so that equal rows are adjacent. A null conv_id is a conversation too. A role is told by its first letter; one that is not s, u or
    a can only be changed or deleted. An empty table gives no rows. Other columns are not read.

    Neither texts nor rows of a conversation are held together: its codes (a byte for each row) are, and then its audit, which is as
    long and is a value of the result. A conversation's rows pass through one task, as SHA-256 of the whole text is taken in order.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    damaged = damage(rows)
    cells = _faults(damaged).select("conv_id", "turn", "role", "mark", "code", "n", "first")
    # A cell without rows for every conversation there was.
    all_names = rows.select("conv_id").distinct()
    blanks = [F.lit(v).cast(t).alias(n) for n, t, v in (("turn", "bigint", None), ("role", "string", ""), ("mark", "binary", None), ("code", "int", 0), ("n", "bigint", 0), ("first", "boolean", False))]
    ordered = cells.unionByName(all_names.select("conv_id", *blanks)).repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "mark").select("conv_id", "turn", "code", "n", "first")
    ddl = f"conv_id {kind}, {_AUDIT}"
    audits = materialise(ordered.mapInArrow(_audits(to_arrow_schema(StructType.fromDDL(ddl))), ddl), "audits")

    # Each conversation's audit goes ahead of its rows. Rows that an audit deletes need no text, but keep their places.
    names = [f.name for f in audits.schema if f.name != "conv_id"]
    turns = damaged.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    turns = turns.select(F.lit(1).alias("part"), "conv_id", "turn", "role", _mark().alias("mark"), "text", "n")
    stream = audits.withColumn("part", F.lit(0)).unionByName(turns, allowMissingColumns=True).repartition("conv_id")
    stream = stream.sortWithinPartitions("conv_id", "part", "turn", "role", "mark").select("conv_id", *names, "role", "text", "n")
    ddl = f"conv_id {kind}, {_AUDIT}, repaired_sha256 string"
    return stream.mapInArrow(_hashes(to_arrow_schema(StructType.fromDDL(ddl))), ddl)


#: The same rows by keeping, after each row, the best edits for each state with their letters and the text written so far.
ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: xor(x // 2, 3988292384::BIGINT * (x % 2)))), 4294967295::BIGINT) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, (VALUES (0), (1)) copies(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)),
marked AS (
  SELECT *, substring(role, 1, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat(role, ':', text))) AS i FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM marked),
turns AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    concat(lag(initial) OVER (PARTITION BY conv_id ORDER BY i), initial) AS pair FROM numbered),
inserted(a, b, cost, letters, written) AS (VALUES
  ('E', 'E', 0, '', ''), ('S', 'S', 0, '', ''), ('U', 'U', 0, '', ''), ('A', 'A', 0, '', ''),
  ('E', 'U', 2, 'I', concat(chr(10), 'user:')), ('S', 'U', 2, 'I', concat(chr(10), 'user:')), ('A', 'U', 2, 'I', concat(chr(10), 'user:')),
  ('U', 'A', 2, 'I', concat(chr(10), 'assistant:')),
  ('E', 'A', 4, 'II', concat(chr(10), 'user:', chr(10), 'assistant:')), ('S', 'A', 4, 'II', concat(chr(10), 'user:', chr(10), 'assistant:'))),
legal(a, initial, b, name) AS (VALUES ('E', 's', 'S', ''), ('E', 'u', 'U', 'user'), ('S', 'u', 'U', 'user'), ('A', 'u', 'U', 'user'), ('U', 'a', 'A', 'assistant')),
names AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 'E' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS written FROM names
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit, best.written FROM (
    SELECT conv_id, i, state, min({'cost': cost, 'audit': audit, 'written': written}) AS best FROM (
      SELECT w.conv_id, t.i, n.b AS state, CAST(w.cost + n.cost + 3 AS BIGINT) AS cost, concat(w.audit, n.letters, 'D') AS audit,
        concat(w.written, n.written) AS written
      FROM walk w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1 JOIN inserted n ON n.a = w.state
      UNION ALL
      SELECT w.conv_id, t.i, l.b, CAST(w.cost + n.cost + CASE WHEN keep THEN 0 ELSE 2 END + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS BIGINT),
        concat(w.audit, n.letters, CASE WHEN keep THEN 'K' ELSE 'R' END),
        concat(w.written, n.written, chr(10), CASE WHEN keep THEN t.role ELSE l.name END, ':', t.text)
      FROM walk w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1 JOIN inserted n ON n.a = w.state
      JOIN legal l ON l.a = n.b, (VALUES (true), (false)) edits(keep)
      WHERE fault NOT IN ('blank', 'duplicate') AND CASE WHEN keep THEN l.initial = t.initial ELSE l.name <> '' END)
    GROUP BY conv_id, i, state)),
counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
ended AS (
  SELECT w.conv_id, min({'cost': w.cost + n.cost, 'audit': concat(w.audit, n.letters), 'written': concat(w.written, n.written)}) AS best
  FROM walk w JOIN names m ON w.conv_id IS NOT DISTINCT FROM m.conv_id LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM m.conv_id
  JOIN inserted n ON n.a = w.state AND n.b IN ('E', 'A') WHERE w.i = coalesce(c.n, 0) GROUP BY w.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substring(best.written, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
