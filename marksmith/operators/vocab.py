"""Corpus vocabulary, encode and decode.

Ids: the reserved tokens first (unknown 0, begin 1, end 2), then corpus tokens by
frequency (descending) and text. Numbering uses the distributed dense position,
not a single-task window, since a corpus vocabulary grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marksmith.functions.text import RESERVED, UNK, tokens
from marksmith.operators.joins import lookup_join
from marksmith.operators.position import with_position


def token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n) of all whitespace tokens of ``text_col`` but the reserved ones."""
    toks = texts.select(F.explode(tokens(F.col(text_col))).alias("token"))
    toks = toks.filter(~F.col("token").isin(list(RESERVED)))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))  # partial agg map-side


def build_vocab(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n, id) over all whitespace tokens of ``text_col``."""
    ranked = with_position(token_counts(texts, text_col), [F.desc("n"), F.asc("token")])
    return ranked.select("token", "n", (F.col("pos") + len(RESERVED)).alias("id"))


def reserved_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, 0, i) for t, i in RESERVED.items()], "token string, n long, id long")


def lookup_table(vocab: DataFrame) -> DataFrame:
    return vocab.select("token", "id").unionByName(
        reserved_rows(vocab.sparkSession).select("token", "id"))


def encode(df: DataFrame, row_id: str, tokens_col: Column, vocab: DataFrame,
           out: str = "ids", vocab_rows: int | None = None) -> DataFrame:
    """Add ``out`` = token ids of ``tokens_col`` (unknown tokens -> id 0).

    Explode with position, look up, and rebuild the ordered array per row; the
    per-row group is one text, so bounded by the text's length. ``df`` is read
    twice (tokens, join back): pass a materialised table when it is expensive.
    """
    lut = lookup_table(vocab).select(F.col("token").alias("_tok"), F.col("id").alias("_vid"))
    ex = df.select(row_id, F.posexplode(tokens_col).alias("_i", "_tok"))
    hit = lookup_join(ex, lut, ["_tok"], "left", lookup_rows=vocab_rows,
                      salt_by=F.struct(F.col(row_id), F.col("_i")))
    back = hit.groupBy(row_id).agg(
        F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_vid", F.lit(RESERVED[UNK]))
                                              .cast("int").alias("_vid")))).alias("_pairs"))
    back = back.select(row_id, F.transform("_pairs", lambda p: p["_vid"]).alias(out))
    return df.join(back, row_id, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast("array<int>")))


def decode(df: DataFrame, row_id: str, ids_col: Column, vocab: DataFrame, out: str = "decoded",
           vocab_rows: int | None = None) -> DataFrame:
    """Add ``out`` = ids mapped back to tokens, joined by one space."""
    lut = lookup_table(vocab).select(F.col("id").cast("int").alias("_id"), F.col("token").alias("_tok"))
    ex = df.select(row_id, F.posexplode(ids_col).alias("_i", "_id"))
    hit = lookup_join(ex, lut, ["_id"], "left", lookup_rows=vocab_rows,
                      salt_by=F.struct(F.col(row_id), F.col("_i")))
    back = hit.groupBy(row_id).agg(
        F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_tok", F.lit(UNK)).alias("t"))))
        .alias("_pairs"))
    back = back.select(row_id, F.array_join(F.transform("_pairs", lambda p: p["t"]), " ").alias(out))
    return df.join(back, row_id, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))
