import hashlib
import random

from pyspark.sql import functions as F

from emberlane.llm import fingerprints
from tests.llm.tables import TEXTS, no_documents, odd_documents


def paragraphs(text):
    return {line for line in text.split("\n") if line.strip(" ")}


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append(
            (
                i,
                len(text),
                hashlib.sha256(edited.encode()).hexdigest(),
                round(likeness(paragraphs(text), paragraphs(edited)), 9),
                round(likeness(paragraphs(text), paragraphs(following)), 9),
            )
        )
    return sorted(out, key=repr)


def test_edits_and_likeness_equal_brute_force(spark):
    # 300 lines against 300 others need several larger sketches.
    rows = TEXTS + [(500 + k, "\n".join(f"{k} {j}" for j in range(300 * (k % 2) + 2))) for k in range(12)]
    docs = odd_documents(spark).select("doc_id", "text", "row").limit(0)
    docs = docs.unionByName(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, row int"))
    found = fingerprints.fingerprint_edits(docs).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert sorted(got, key=repr) == expected(rows)
    same = {r.doc_id: r.fingerprint for r in found}
    assert same[0] == same[6] and same[0] != same[7] and same[1] == same[2] == ""


def neighbours_by_hand(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    return sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=repr)


def test_neighbours_of_sparse_repeated_and_missing_ids(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(-(1 << 62), 1 << 62), f"t{k}") for k in range(300)] + [(5, f"same {k}") for k in range(40)]
    rows += [(None, f"{chr(33 + k % 90)} none {k}") for k in range(200)] + [(None, "")] * 3 + [(k, f"é{k}") for k in range(50)]
    for part in (rows, rows[:1], rows[340:], rows[300:340], rows[:0]):
        table = spark.createDataFrame(part, "id bigint, text string").repartition(3)
        for blocks in (1, 2, 7, 64):
            got = fingerprints.with_next_text(table, blocks).collect()
            assert sorted((tuple(r) for r in got), key=repr) == neighbours_by_hand(part)
    table = spark.createDataFrame(rows, "id bigint, text string")
    sizes = [r.n for r in table.groupBy(fingerprints.id_blocks(table, 16).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) <= 60


def test_recovered_digests_are_the_differing_paragraphs(spark):
    docs = spark.createDataFrame([(2, "a\nb\nc\nd"), (1, "x\ny\nz\nw")], "doc_id bigint, text string")
    row = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}[2]
    # n = 7: the last 3 code points "c\nd" become "x\ny".
    digest = {p: spark.sql(f"select xxhash64('{p}') d").first().d for p in "cdxy"}
    assert set(row.removed_digests) == {digest["c"], digest["d"]}
    assert set(row.added_digests) == {digest["x"], digest["y"]}


def test_a_single_row_is_its_own_next_and_an_empty_table_gives_nothing(spark):
    one = spark.createDataFrame([(3, "ab\ncd")], "doc_id bigint, text string")
    row = fingerprints.fingerprint_edits(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"ab\nab").hexdigest() and row.near_next == 1
    assert fingerprints.fingerprint_edits(no_documents(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = fingerprints.fingerprint_edits(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
