"""Token counts with a digest cache: only texts whose count is not stored yet are encoded, each distinct one once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.common import file_digest, keyed_text, slices
from emberlane.llm.tokens import byte_bpe
from emberlane.session import materialise

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version: its file and the rules of counting."""
    import tokenizers

    return file_digest(path, tokenizers.__version__, "no added special tokens, no truncation, no padding")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path).encode
        for batch in slices(batches):
            counts = [len(encode(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"]
            )

    return run


def known_counts(spark, cache_path: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer version; a row that a repeated write stored twice counts once."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == tokenizer)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def add_missing_counts(rows: DataFrame, tokenizer_path: str, cache_path: str) -> None:
    """Encode what the cache lacks of ``rows`` (id, content, text) and append the counts to it.

    Which row stands for a digest is settled on (id, digest) alone; the texts are then shuffled once, by both
    columns, so that a text which a third of all rows share does not gather its rows in one task.
    """
    spark = rows.sparkSession
    tokenizer = tokenizer_digest(tokenizer_path)
    # Makes the folder, so that the first run reads an empty cache instead of failing.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    distinct = rows.groupBy("content").agg(F.min("id").alias("first_id"))
    misses = distinct.join(known_counts(spark, cache_path, tokenizer), "content", "left_anti")
    misses = misses.withColumnRenamed("content", "missing")
    texts = rows.join(
        misses.hint("shuffle_hash"),
        (rows["content"] == misses["missing"]) & rows["id"].eqNullSafe(misses["first_id"]),
        "left_semi",
    )
    found = texts.select("content", "text").mapInArrow(_encode(tokenizer_path), "content binary, n_tokens bigint")
    # Rows that repeat both id and text are encoded each; the cache gets their count once.
    found = found.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    found.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``cache_path`` is a Parquet folder of (content digest, tokenizer digest, count) in a place all executors
    share; it is made if missing and grows by the counts of new texts. The digest is SHA-256 of the text
    itself, as any change to a text may change its count. Texts are encoded whole, as the tokenizers library does
    by default: special strings inside a text are the special tokens.

    Null text counts as empty (0 tokens). Rows with a null or repeated id stay, each with its own count.
    An empty table gives no rows and leaves the cache as it is. Other columns are not read.
    """
    rows = keyed_text(docs, id_col, text_col).select(
        "id", F.unhex(F.sha2("text", 256)).alias("content"), "text"
    )
    add_missing_counts(rows, tokenizer_path, cache_path)
    spark = docs.sparkSession
    # Written, so that the join below reads both sides straight from shuffles and adaptive execution can split a hot digest.
    counts = materialise(known_counts(spark, cache_path, tokenizer_digest(tokenizer_path)), "token-counts")
    sized = rows.select("id", "content", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return sized.join(counts, "content", "left").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
