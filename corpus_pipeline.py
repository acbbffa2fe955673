"""Corpus preparation: stages that each work on all their predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlane.llm import language, near_dedup, packing, pii, queries
from emberlane.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's own languages: the model learns from the labelled ones, and what it rejects goes."""
    return language.keep_accepted(docs, language.fit(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose shingles are alike to 0.8 or more, directly or over others, the one with the smallest id.

    A pair at a similarity of 0.8 agrees in fewer than 79 of 128 coordinates about once in a million.
    """
    return near_dedup.one_of_each_group(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every span of personal data replaced by its kind."""
    return pii.mask_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_languages),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: No SQL expresses trained models, signatures or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``; what each one keeps is written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
