"""Pair sets derived from the corpus tables.

* ``documents``: one pair per document, key and response both the text; the
  cyclic pairing then gives signature ``i`` from document ``(p + 1024 i) mod N``.
* ``conversations``: a user turn and the assistant turn that follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksmith.operators.position import with_position, with_position_by_key
from marksmith.sources.readers import read_table


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpositioned pair set (doc_id, key, response); position it with ``order=['doc_id']``
    after narrowing (``assemble_registry`` does)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.col("text").alias("key"), F.col("text").alias("response"))


def document_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos) only: the narrow table to position when texts are not needed."""
    return with_position(read_table(spark, sf_dir, "documents", "doc_id"), ["doc_id"])


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned pair set with whole texts (only for queries that output whole texts)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return with_position_by_key(docs, ["doc_id"]).select(
        "pos", "doc_id", F.col("text").alias("key"), F.col("text").alias("response"))


def conversation_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, key, response): user turn + next assistant turn.

    An equi-join on (conv_id, turn + 1): hash partitioned on both columns, so a
    very long conversation is spread over many tasks (a window per
    conversation would put it in one)."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    user = conv.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("key"))
    asst = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(asst, ["conv_id", "turn"])


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position_by_key(conversation_turn_pairs(spark, sf_dir), ["conv_id", "turn"])


# SQL of the same pair sets (DuckDB oracle).
SQL_DOCUMENT_PAIRS = """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, text AS key, text AS response
FROM documents
"""

SQL_CONVERSATION_PAIRS = """
SELECT row_number() OVER (ORDER BY u.conv_id, u.turn) - 1 AS pos, u.conv_id, u.turn,
       u.text AS key, a.text AS response
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""
