"""A corpus pipeline of the operators in ``marksmith.llm``.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and returns the rows
that the next stage reads as its documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marksmith.llm import (decontamination, exact_dedup, language_id, near_join,
                           sentencepiece_codec)
from marksmith.llm.common import read, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.one_of_each_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_decode(docs, sentencepiece_codec.default_model())
    return sentencepiece_codec.digest_columns(coded)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", token_ids),
]

#: The language model, the forest and the tokenizer are no SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
