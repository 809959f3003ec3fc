"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marksmith.session import ensure_checkpoint_dir

#: Rows of one Arrow batch handed to Python. Texts are whole, so a batch is kept short.
BATCH_ROWS = "500"
#: Id tables up to this many rows (8 bytes each) may be broadcast; larger ones are shuffled.
MAX_BROADCAST_IDS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder (see ``marksmith.session``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a compressed table to the shared checkpoint folder and read it back: like a
    checkpoint, for what is too large to keep uncompressed."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch_tables(spark: SparkSession):
    """A ``written`` whose tables are deleted at the end of the block: for what a result that is
    itself written before then was made from."""
    made = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        yield keep
    finally:
        for folder in made:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def short_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session already chose a value."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | T.StructType,
                setup: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` with one dict of columns per batch.

    ``fn(batch)`` (or ``fn(batch, state)`` when ``setup`` builds a per-task state) returns
    ``{column: list or Arrow array}``.
    """
    short_batches(df.sparkSession)
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = fn(batch, state) if setup else fn(batch)
            arrays = []
            for field in arrow:
                col = cols[field.name]
                arrays.append(col.cast(field.type) if isinstance(col, (pa.Array, pa.ChunkedArray))
                              else pa.array(col, type=field.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, struct)


def text_column(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def keep_or_drop_ids(df: DataFrame, ids: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join of wide rows with a narrow key table, null keys matching null.

    The key table is counted first: up to ``MAX_BROADCAST_IDS`` rows it is broadcast, so the
    texts are not shuffled; beyond that a shuffle join is left to adaptive execution.
    """
    rows = ids.count()
    right = ids.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(right[f"_k_{k}"])
        cond = c if cond is None else cond & c
    return df.join(F.broadcast(right) if rows <= MAX_BROADCAST_IDS else right, cond, how)


def one_of_tied(rows: DataFrame, tied: DataFrame, keys: list[str]) -> DataFrame:
    """All rows, but one for each key of ``tied`` (keys of repeated rows)."""
    if tied.isEmpty():
        return rows
    once = keep_or_drop_ids(rows, tied, keys, "left_anti")
    repeats = keep_or_drop_ids(rows, tied, keys, "left_semi")
    return once.unionByName(repeats.dropDuplicates(keys))


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows as one struct ``_row`` beside helper columns, whatever their own names are."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       *[col.alias(name) for name, col in keys.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def min_label_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table as ``(node, label)``, the label being
    the smallest node. Null ends and self-loops are ignored.

    Rounds of neighbour minima followed by a pointer jump. Every round is aggregated before its
    shuffle and checkpointed; no neighbour list is ever collected.
    """
    both = (edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
            .filter("u is not null and v is not null and u <> v").distinct())
    both = checkpointed(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
                        .distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("node"))
                          .agg(F.min("v").alias("m"))
                          .select("node", F.least("node", "m").alias("label")))
    while True:
        near = (both.join(labels, both["v"] == labels["node"])
                .groupBy(F.col("u").alias("n2")).agg(F.min("label").alias("near")))
        stepped = (labels.join(near, labels["node"] == near["n2"], "left")
                   .select("node", F.col("label").alias("old"),
                           F.least("label", F.coalesce("near", "label")).alias("label")))
        stepped = checkpointed(stepped)
        root = stepped.select(F.col("node").alias("r"), F.col("label").alias("rl"))
        jumped = checkpointed(stepped.join(root, stepped["label"] == root["r"], "left")
                              .select("node", "old", F.least("label", F.coalesce("rl", "label"))
                                      .alias("label")))
        changed = jumped.filter("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


class BoundedTable:
    """A dict of at most ``2 * size`` entries that forgets the entries longest unused.

    ``fresh(keys)`` gives the keys that must be learned; after ``learn`` every key of the batch
    is in ``now``. What is forgotten is learned again, so results never depend on the bound.
    """

    def __init__(self, size: int):
        self.size, self.now, self.before = size, {}, {}

    def fresh(self, keys: set) -> list:
        missing = keys.difference(self.now)
        if len(self.now) + len(missing) > self.size:
            self.before, self.now = self.now, {}
            missing = keys
        before, now = self.before, self.now
        new = []
        for k in missing:
            if k in before:
                now[k] = before[k]
            else:
                new.append(k)
        return new

    def learn(self, keys: list, values) -> None:
        self.now.update(zip(keys, values, strict=True))

    def forget(self, keys) -> None:
        for k in keys:
            self.now.pop(k, None)
