"""Looking up the range that a point falls in, without a join on an inequality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksmith.operators.position import default_partitions
from marksmith.session import ensure_checkpoint_dir


def last_mark(points: DataFrame, point: Column, marks: DataFrame, mark: Column, take: Column,
              out: str, num_partitions: int | None = None) -> DataFrame:
    """Each row of ``points`` with ``out``: ``take`` of the last mark at or below ``point`` (null
    if there is none). Marks are distinct values.

    Points and marks become one table, range-partitioned by value, so every task holds a run of
    neighbouring values; points of one very common value are spread by a hash of their row. In a
    task the last mark is carried along the sorted rows; what a task takes over from those before
    it comes from a table with one row per partition. Nothing is replicated.
    """
    ensure_checkpoint_dir(points.sparkSession)
    kind = marks.select(take.alias("t")).schema["t"].dataType
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    both = points.select(point.alias("_v"), F.lit(1).alias("_kind"), row.alias("_row"),
                         F.lit(None).cast(kind).alias("_take"))
    row_type = both.schema["_row"].dataType
    both = both.unionByName(marks.select(mark.alias("_v"), F.lit(0).alias("_kind"),
                                         F.lit(None).cast(row_type).alias("_row"), take.alias("_take")))
    both = both.filter("_v is not null").withColumn("_by", F.xxhash64("_row"))
    n = num_partitions or default_partitions(points)
    along = ["_v", "_kind", "_by"]
    ranged = (both.repartitionByRange(n, *along).sortWithinPartitions(*along)
              .withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))
    is_mark = F.col("_kind") == 0
    so_far = Window.partitionBy("_part").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(F.when(is_mark, F.struct(F.col("_take").alias("t"))), ignorenulls=True).over(so_far)
    ends = ranged.groupBy("_part").agg(
        F.max_by(F.struct(F.col("_take").alias("t")), F.when(is_mark, F.col("_v"))).alias("end"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", F.last("end", ignorenulls=True).over(before).alias("_before"))
    found = ranged.withColumn("_here", here).filter(~is_mark).join(F.broadcast(ends), "_part")
    return found.select("_row.*", F.coalesce("_here", "_before")["t"].alias(out))
