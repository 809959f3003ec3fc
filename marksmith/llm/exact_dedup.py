"""Exact dedup against a persistent digest index (operator 8).

The index is a table ``(digest, keep_id, group_size, attempt)`` bucketed and sorted by digest. A
batch of documents is reduced to digests, aggregated per digest before its shuffle, compared with
the index by a sort-merge anti-join and what is new is appended; every result is then read from
the index. The first batch takes the same path with an empty index. The index side of the joins
needs no exchange; it needs no sort while a bucket is one file, as it is after ``compact`` (each
append adds a file to a bucket). Only DataFrame functions run.

A batch has a name. Its rows are appended under an attempt of their own, and count only once the
attempt is committed in a second table, with one row written last. A batch that failed before its
commit leaves rows that nobody reads; run again, it appends under another attempt. A batch that
is run again after its commit meets its own rows as its own and gives the same result.

Defined results: a null text is the empty text, and empty texts are equal to each other; texts
are compared unchanged, by SHA-256 of their UTF-8 bytes. Of equal texts the largest ``doc_id``
stays; a null ``doc_id`` stays only where the group has no other id. Rows that repeat both
``doc_id`` and text are one document: each row gets the same result, and ``deduplicate`` returns
one of them. Extra columns are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksmith.llm.common import (checkpointed, keep_or_drop_ids, one_of_tied, packed, read,
                                  sha256_hex, text_column, unpacked)

#: A digest is hot when its group holds at least one part in HOT_PARTS of the batch, so there
#: are never more than HOT_PARTS hot digests: that table is broadcast.
HOT_PARTS = 1000


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far. A ``temporary`` one is dropped when
    its first batch has been decided."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None,
                 temporary: bool = False):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.commits_name = f"{self.name}_commits"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.temporary = temporary

    def exists(self) -> bool:
        catalog = self.spark.catalog
        compacted = f"{self.name}_compacted"
        if not catalog.tableExists(self.name) and catalog.tableExists(compacted):
            self.spark.sql(f"ALTER TABLE {compacted} RENAME TO {self.name}")
        return catalog.tableExists(self.name)

    def commits(self) -> DataFrame:
        """``batch, attempt``: one row per committed batch."""
        if not self.spark.catalog.tableExists(self.commits_name):
            return self.spark.range(0).selectExpr("'' AS batch", "'' AS attempt")
        return self.spark.table(self.commits_name).groupBy("batch").agg(
            F.min("attempt").alias("attempt"))

    def attempt_of(self, batch: str) -> str | None:
        row = self.commits().filter(F.col("batch") == batch).first()
        return row["attempt"] if row else None

    def table(self, but: str | None = None) -> DataFrame:
        """The rows of all committed batches (but one)."""
        live = self.commits()
        if but is not None:
            live = live.filter(F.col("batch") != but)
        # one row per batch
        return self.spark.table(self.name).join(F.broadcast(live.select("attempt")), "attempt",
                                                "left_semi")

    def unseen(self, groups: DataFrame, batch: str) -> DataFrame:
        """The groups whose digest no other batch holds; a new index is created empty."""
        if not self.exists():
            self.append(groups.limit(0), "")
        known = self.table(but=batch).select("digest")
        return groups.join(known.hint("merge"), "digest", "left_anti")

    def _write(self, rows: DataFrame, name: str) -> None:
        (rows.select("digest", "keep_id", "group_size", "attempt")
         .repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet")
         .mode("append").saveAsTable(name))

    def append(self, groups: DataFrame, attempt: str) -> None:
        """Append groups under an attempt, one sorted file per bucket."""
        self._write(groups.withColumn("attempt", F.lit(attempt)), self.name)

    def commit(self, batch: str, attempt: str) -> None:
        (self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"))
         .write.format("parquet").mode("append").saveAsTable(self.commits_name))

    def compact(self) -> None:
        """One file per bucket, without the rows of attempts that were never committed."""
        compacted = f"{self.name}_compacted"
        if self.exists():
            self.spark.sql(f"DROP TABLE IF EXISTS {compacted}")
            self._write(self.table(), compacted)
            self.spark.sql(f"DROP TABLE {self.name}")
            self.exists()

    def drop(self) -> None:
        for name in (self.name, self.commits_name):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest)`` of every row; the digest is 32 bytes."""
    return docs.select("doc_id", F.unhex(sha256_hex(text_column())).alias("digest"))


def batch_groups(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"),
                                       F.count(F.lit(1)).alias("group_size"))


def decide(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Index the batch and return ``(doc_id, digest, keep_id, group_size, kept)`` per row.

    Documents whose digest another batch holds get that batch's ``keep_id`` and ``group_size`` and
    are not kept. With a ``batch`` name, running it again gives the same rows again.
    """
    batch = batch or uuid.uuid4().hex
    keyed = checkpointed(digests(docs))
    total = keyed.count()
    groups = checkpointed(batch_groups(keyed))
    own = index.attempt_of(batch)
    if own is None:
        own = uuid.uuid4().hex
        index.append(index.unseen(groups, batch), own)
        index.commit(batch, own)
    marks = checkpointed(
        index.table().join(groups.select("digest").hint("merge"), "digest")
        .select(F.col("digest").alias("d2"), "keep_id", "group_size",
                (F.col("attempt") == own).alias("fresh")))
    if index.temporary:
        index.drop()
    hot = groups.filter(F.col("group_size") * HOT_PARTS >= F.lit(total)).select(
        F.col("digest").alias("d2"))
    hot_marks = checkpointed(marks.join(F.broadcast(hot), "d2", "left_semi"))
    # the hot groups are looked up by broadcast, so no task receives a whole group
    is_hot = F.broadcast(hot_marks)
    lit = keyed.join(is_hot, keyed["digest"] == is_hot["d2"])
    cold = keyed.join(F.broadcast(hot_marks.select("d2")), keyed["digest"] == F.col("d2"),
                      "left_anti").join(marks, keyed["digest"] == marks["d2"])
    cols = ["doc_id", "digest", "keep_id", "group_size",
            (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")]
    return lit.select(*cols).unionByName(cold.select(*cols))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None,
                batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    index = index or DigestIndex(docs.sparkSession, temporary=True)
    decided = checkpointed(decide(docs, index, batch))
    dropped = decided.filter(~F.col("kept")).select("doc_id", "digest")
    keyed = packed(docs, doc=F.col("doc_id"), digest=F.unhex(sha256_hex(text_column())))
    gone = dropped.select(F.col("doc_id").alias("doc"), "digest").distinct()
    kept = keep_or_drop_ids(keyed, gone, ["doc", "digest"], "left_anti")
    tied = checkpointed(decided.filter("kept").groupBy(F.col("doc_id").alias("doc"), "digest")
                        .count().filter("count > 1").select("doc", "digest"))
    return unpacked(one_of_tied(kept, tied, ["doc", "digest"]))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decide(read(spark, sf_dir, "documents"), DigestIndex(spark, temporary=True))
    return decided.select("doc_id", "keep_id", "group_size", "kept",
                          F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
