"""Every registered query on the smallest tables: columns in the given order, their types, one row for each row it must answer for."""

import pytest
from pyspark.sql import functions as F

from emberlane.llm import queries

SMALL = "/root/testdata/sf0.001"
COUNTS = "kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
# Columns of each query and the table whose every row it answers for; the others have tests of their own.
COLUMNS = {
    1: ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", "documents"),
    2: ("doc_id bigint, held_out boolean, lang_pred string, score double", "documents"),
    3: ("page_id bigint, url string, text string, n_chars bigint", "pages"),
    4: ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double", "documents"),
    5: ("query_id bigint, rank int, vec_id bigint, score double", None),
    6: ("doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", "documents"),
    7: ("doc_id bigint, n_shingles bigint, component_id bigint, kept boolean", "documents"),
    8: ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", None),
    9: ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", "documents"),
    10: ("doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "documents"),
    11: (f"part string, filter_order string, step int, {COUNTS}", None),
    12: ("doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string", "documents"),
    13: ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string", None),
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0])))
def test_columns_and_rows(spark, name):
    columns, source = COLUMNS[int(name[2:].split("_")[0])]
    found = queries.QUERIES[name](spark, SMALL).persist()
    wanted = [tuple(c.split(" ")) for c in columns.split(", ")]
    try:
        assert found.dtypes[: len(wanted)] == wanted
        if source:
            key = wanted[0][0]
            rows = queries.table(spark, SMALL, source).select(key)
            assert found.select(key).exceptAll(rows).count() == 0 and rows.exceptAll(found.select(key)).count() == 0
    finally:
        found.unpersist()


def test_neighbours_of_every_hundredth_vector(spark):
    vectors = queries.table(spark, SMALL, "embeddings").filter("vec_id % 100 = 0").count()
    found = queries.QUERIES["op5_nn_descent"](spark, SMALL)
    ranks = found.groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).collect()
    assert len(ranks) == vectors and all(r.ranks == list(range(1, 11)) for r in ranks)


def test_audit_and_repair_answer_for_every_part_and_conversation(spark):
    parts = queries.table(spark, SMALL, "documents").select(F.coalesce("source", F.lit(""))).distinct().count()
    assert queries.QUERIES["op11_filter_audit"](spark, SMALL).count() == parts * 120 * 5
    wanted = queries.table(spark, SMALL, "conversations").select("conv_id").distinct()
    found = queries.QUERIES["op13_conversation_repair"](spark, SMALL).select("conv_id")
    assert found.exceptAll(wanted).count() == 0 and wanted.exceptAll(found).count() == 0


def test_pieces_cover_every_document(spark):
    docs = queries.table(spark, SMALL, "documents").select("doc_id").distinct()
    pieces = queries.QUERIES["op8_best_fit_packing"](spark, SMALL)
    ends = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"))
    assert ends.filter("n <> end").count() == 0 and ends.select("doc_id").exceptAll(docs).count() == 0
    assert ends.count() == docs.count() and pieces.filter("length > 2048 or offset + length > 2048").count() == 0
