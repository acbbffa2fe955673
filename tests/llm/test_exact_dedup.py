import hashlib
import random

import pytest

from emberlane.llm import exact_dedup
from tests.llm.tables import TEXTS, no_documents, odd_documents


def plain(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(plain(text), []).append(i)
    result = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        for place, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0))):
            result.append((i, keep, len(ids), place == len(ids) - 1, digest))
    return sorted(result, key=repr)


def got(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def copies(seed, n=400):
    draw = random.Random(seed)
    texts = ["one text", "One Text", "ONE TEXT ", "É", "é", "", None, "a" * 5000, "A" * 5000] + [f"text {k}" for k in range(80)]
    # A third of all rows are copies of one text.
    rows = [(k, draw.choice(texts) if k % 3 else draw.choice(["Hot", "hoT"])) for k in range(n)]
    rows += [(None, "hot"), (None, "only without ids"), (None, "only without ids"), (5, "Text 1"), (5, "text 1")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_equal_to_grouping_by_text(spark, tmp_path, digest_bytes):
    rows = copies(digest_bytes)
    path = str(tmp_path / "documents.parquet")
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, digest string, row int")
    docs.repartition(6).write.parquet(path)
    # With one byte of the digest, most hits are other texts; files are taken two at a time.
    found = exact_dedup.find_copies(spark, path, digest_bytes=digest_bytes, files_per_batch=2)
    assert got(found) == brute(rows)


def test_a_later_run_takes_in_new_files_only(spark, tmp_path):
    first, second = copies(11, 60), [(k + 1000, t) for k, (_, t) in enumerate(copies(12, 60))]
    path, state = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    schema = "doc_id bigint, text string"
    spark.createDataFrame(first, schema).write.parquet(path)
    assert got(exact_dedup.find_copies(spark, path, state)) == brute(first)
    spark.createDataFrame(second, schema).write.mode("append").parquet(path)
    assert got(exact_dedup.find_copies(spark, path, state)) == brute(first + second)
    known = exact_dedup.update_known(spark, path, state)
    assert known.agg({"n": "sum"}).first()[0] == len(first) + len(second)
    batches = spark.read.parquet(f"{state}/changes").groupBy("batch").agg({"n": "max"}).collect()
    assert len(batches) == 2  # the third run found nothing new


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    odd_documents(spark).write.parquet(str(tmp_path / "odd"))
    assert got(exact_dedup.find_copies(spark, str(tmp_path / "odd"))) == brute(TEXTS)
    one_file = "/root/testdata/sf0.001/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(one_file).collect()]
    assert got(exact_dedup.find_copies(spark, one_file)) == brute(rows)
    no_documents(spark).write.parquet(str(tmp_path / "none"))
    assert got(exact_dedup.find_copies(spark, str(tmp_path / "none"))) == []
