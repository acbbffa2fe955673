from pyspark.sql import functions as F

import corpus_pipeline
from emberlane.llm import near_dedup, pii, queries
from tests.llm.tables import no_documents, odd_documents


def test_stages_take_effect_and_feed_each_other(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = odd_documents(spark).select(source.columns).withColumn("doc_id", F.col("doc_id") + 10**7)
    foreign = spark.createDataFrame([(10**9, "привет это длинный текст на другом языке " * 5, None, "s", 10)], source.schema)
    source.unionByName(odd).unionByName(foreign).write.parquet(str(tmp_path / "documents.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, str(tmp_path))
        assert new.columns == columns
        new.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert 10**9 not in ids["language"] and 10**7 + 1 not in ids["language"] and 0 in ids["language"]
    assert len(ids["language"]) >= 0.95 * source.count()
    groups = near_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "language"))).collect()
    assert ids["near_duplicates"] == {r.component_id for r in groups} == ids["personal_data"]
    texts = [r.text for r in spark.read.parquet(str(tmp_path / "near_duplicates")).filter("doc_id is null").collect()]
    assert texts == ["a row without an id"]
    left = pii.find_personal_data(docs).filter("n_email + n_ip + n_card + n_phone > 0").count()
    assert left == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids["personal_data"]


def test_every_stage_takes_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        columns = ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, no_documents(spark).select(columns), "").count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))


def test_copies_alike_to_four_fifths_are_one(spark):
    words = [f"w{k}" for k in range(204)]
    other = list(words)
    for k in (30, 80, 130, 180):
        other[k] = f"x{k}"
    # 200 shingles each, 180 shared: 180 / 220 = 0.818, above 0.8 and below 0.85.
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(other), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()] == [1]
    assert near_dedup.near_duplicates(docs, percent=85, matches=88).filter("kept").count() == 2
