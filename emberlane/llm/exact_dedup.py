"""Exact deduplication as a stream whose keyed state lies on disk and never expires.

1. The folder of documents is read as a stream. The state, kept by RocksDB, holds for each digest the identifier and the content
   locator (file and row in it) of the document that stays, and how many documents had the digest so far. A later run with the same
   state reads only new files.
2. A document whose digest is held by another one is a hit. Hits are believed only after their bytes: texts are fetched by their
   locators, and every hit is compared in full with the document that its digest points to.
3. Hits that differ from it become groups of their own, by digest and whole text. With SHA-256 there are none, and the tables of
   this step are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm.common import whole_text
from emberlane.session import materialise, scratch_path

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # All state partitions of an executor share one bounded cache.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Megabytes are not set aside in advance for every partition's log.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _watched(spark: SparkSession, path: str) -> str:
    """``path`` as a stream takes it: it watches folders and patterns, so a single file becomes a pattern of that name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    return f"{path[:-1]}[{path[-1]}]" if is_file else path


def located(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """(id, file, row, sha, digest, text): each document with its place in the folder and its text in lower case (A-Z only)."""
    place = docs.metadataColumn("_metadata")
    text = F.translate(whole_text(text_col), _UPPER, _UPPER.lower())
    rows = docs.select(
        F.col(id_col).alias("id"), place["file_path"].alias("file"), place["row_index"].alias("row"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text")
    )
    return rows.withColumn("digest", F.substring("sha", 1, digest_bytes))


def update_known(
    spark: SparkSession, path: str, state_path: str, *, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, files_per_batch: int = 10_000
) -> DataFrame:
    """Take in the files of ``path`` that the state has not seen, and return (digest, keeper, n) for every digest.

    ``state_path`` is a folder that all executors reach; it is made if missing. ``keeper`` is (id, file, row) of the largest id, null
    ids last, of equal ids the last by its place. A group of copies reaches the state as one row per task and batch.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_watched(spark, path))
    rows = located(stream, id_col, text_col, digest_bytes)
    state = rows.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("n"))

    def write(changed: DataFrame, batch: int) -> None:
        # By batch, so that a batch which is run again after a failure replaces what it wrote.
        changed.write.mode("overwrite").parquet(f"{state_path}/changes/batch={batch}")

    # Makes the folder, so that a stream without files leaves an empty table.
    empty = spark.createDataFrame([], state.schema)
    empty.write.mode("overwrite").parquet(f"{state_path}/changes/batch=-1")
    with _settings(spark, _DISK_STATE):
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", f"{state_path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    changes = spark.read.schema(state.schema).parquet(f"{state_path}/changes")
    # Each change of a digest counts more documents than the one before.
    return changes.groupBy("digest").agg(F.max_by(F.struct("keeper", "n"), "n").alias("last")).select("digest", "last.keeper", "last.n")


def find_copies(
    spark: SparkSession,
    path: str,
    state_path: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_bytes: int = 32,
    files_per_batch: int = 10_000,
) -> DataFrame:
    """Per row of the Parquet folder or file ``path``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; of equal texts the row with the largest id stays. Null text
    counts as empty. Null ids are smaller than all others; of rows that share the largest id (or have none at all) the one whose
    place in the folder is last stays, so exactly one row of a group does. An empty table gives no rows. Other columns are not read.

    ``state_path`` keeps the stream's state for later runs; without it the state lasts for this run. ``digest_bytes`` is how much of
    the SHA-256 keys the state: fewer bytes give the same result with more texts compared. The folder must not change during a run.
    """
    state_path = state_path or scratch_path(spark, "known-texts")
    known = update_known(spark, path, state_path, id_col=id_col, text_col=text_col, digest_bytes=digest_bytes, files_per_batch=files_per_batch)
    # Written, so that joins read both sides straight from shuffles and adaptive execution can split a hot digest.
    known = materialise(known, "known-digests")
    docs = located(spark.read.parquet(path), id_col, text_col, digest_bytes)
    rows = materialise(docs.drop("text"), "located-digests").join(known, "digest")
    rows = materialise(rows.withColumn("kept", F.expr("file = keeper.file AND row = keeper.row")), "documents-by-digest")

    hits = rows.filter("n > 1").select("id", F.col("file").alias("hit_file"), F.col("row").alias("hit_row"), "sha", "digest", "kept")
    same_place = (F.col("file") == F.col("hit_file")) & (F.col("row") == F.col("hit_row"))
    texts = docs.select("file", "row", "text").join(hits.hint("shuffle_hash"), same_place)
    texts = materialise(texts.select("id", "file", "row", "sha", "digest", "kept", "text"), "hit-texts")
    pointed_at = texts.filter("kept").select("digest", F.col("text").alias("kept_text"))
    differing = texts.filter("NOT kept").join(pointed_at, "digest").filter("text != kept_text").drop("kept", "kept_text")
    differing = materialise(differing, "differing-texts")

    fewer = differing.groupBy("digest").agg(F.count(F.lit(1)).alias("fewer"))
    equal = rows.join(differing.select("file", "row"), ["file", "row"], "left_anti").join(fewer, "digest", "left")
    equal = equal.withColumn("n", F.col("n") - F.coalesce("fewer", F.lit(0)))
    groups = differing.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    other = differing.join(groups, ["digest", "text"]).withColumn("kept", F.expr("file = keeper.file AND row = keeper.row"))
    result = [
        F.col("id").alias(id_col), F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256")
    ]
    return equal.select(*result).unionByName(other.select(*result))


#: ``lower`` would change other letters too.
ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, sha256(s) AS text_sha256 FROM t
"""
