"""Dense 0-based positions without a single-task window (H1).

``row_number() over (order by k)`` with no partition sends every row to one
task. Instead: range-partition on the order, sort inside each partition, stamp a
partition-local id, and checkpoint so that the partition contents are fixed
(range bounds come from sampling and a lost executor must not change them).
Counting rows per partition gives a table with one row per partition, whose
running sum is broadcast (its size is the partition count, which we choose).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marksmith.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id << 33 | row index
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def default_partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_position(df: DataFrame, order: list, name: str = "pos",
                  num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based ``name`` column following ``order`` (a total order).

    ``order`` holds column names or sort expressions (``F.desc('n')``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = num_partitions or default_partitions(df)
    ranged = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    part = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    # one row per partition: a size bound we set ourselves
    joined = ranged.join(F.broadcast(offsets), part == F.col("_part"))
    return joined.withColumn(
        name, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK))).cast("bigint")
    ).drop("_mid", "_part", "_off")


def with_position_by_key(df: DataFrame, keys: list[str], order: list | None = None,
                         name: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Dense positions computed from the key columns alone, then joined back.

    ``order`` (default: ``keys``) may only use the keys. The range sample, shuffle and
    checkpoint then carry a few bytes per row (a parquet scan is pruned to the key columns), and
    the wide or expensive columns of ``df`` are computed once, on the join's map side. Keys that
    do not identify a row are found, and whole rows are positioned instead: see ``placed``."""
    positions = with_position(df.select(*keys), order or keys, name, num_partitions)
    return placed(df, positions, keys, order, name, num_partitions)


def placed(df: DataFrame, positions: DataFrame, keys: list[str], order: list | None = None,
           name: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """``df`` with the positions of its keys, every row with one of its own.

    A null is a key like any other. Where a key repeats, a join could not tell which of its
    positions belongs to which row, so the rows themselves are positioned (rows that agree in
    ``order`` in any order)."""
    repeated = positions.groupBy(*keys).count().filter("count > 1")
    if not repeated.isEmpty():
        return with_position(df, order or keys, name, num_partitions)
    right = positions.select(*[F.col(k).alias(f"_key_{k}") for k in keys], name)
    same = None
    for k in keys:
        one = df[k].eqNullSafe(right[f"_key_{k}"])
        same = one if same is None else same & one
    return df.join(right, same).drop(*[f"_key_{k}" for k in keys])


SINGLE_TASK_GROUP_ROWS = 2_000_000


def segmented_running_sums(df: DataFrame, group: str, order: list, values: dict,
                           num_partitions: int | None = None,
                           single_task_rows: int = SINGLE_TASK_GROUP_ROWS) -> DataFrame:
    """Inclusive running sums of ``values`` (name -> column) within ``group`` along
    ``order`` (a total order inside a group), plus each group's totals
    (``<name>_total``).

    A window per group would put a hot group in one task. Instead the rows are
    range-partitioned on (group, order) — a hot group spans many partitions —
    and checkpointed so the partition contents are fixed. Running sums are taken
    per (partition, group) segment, whose size is bounded by a partition; each
    segment then adds the totals of the same group's earlier segments, computed
    on a segments table with at most one row per partition and group.

    When the largest group is proven small (a partially aggregated count, at
    most ``single_task_rows``), a plain window per group is cheaper and is used.
    """
    ensure_checkpoint_dir(df.sparkSession)
    order_cols = [F.col(group)] + [F.col(c) if isinstance(c, str) else c for c in order]
    inner = [F.col(c) if isinstance(c, str) else c for c in order]
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest <= single_task_rows:
        w = Window.partitionBy(group).orderBy(*inner)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.select("*", *[F.sum(v).over(run).alias(k) for k, v in values.items()],
                         *[F.sum(v).over(whole).alias(f"{k}_total") for k, v in values.items()])
    n = num_partitions or default_partitions(df)
    base = df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    ranged = (base.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))
    w_local = Window.partitionBy("_part", group).orderBy(*inner).rowsBetween(Window.unboundedPreceding, 0)
    ranked_local = ranged.select("*", *[F.sum(f"_v_{k}").over(w_local).alias(f"_l_{k}") for k in values])
    seg = ranged.groupBy("_part", group).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    w_prev = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(group)
    seg = seg.select("_part", group,
                     *[F.coalesce(F.sum(f"_s_{k}").over(w_prev), F.lit(0)).alias(f"_o_{k}") for k in values],
                     *[F.sum(f"_s_{k}").over(w_all).alias(f"{k}_total") for k in values])
    out = ranked_local.join(seg, ["_part", group])
    out = out.select("*", *[(F.col(f"_o_{k}") + F.col(f"_l_{k}")).alias(k) for k in values])
    drop = ["_part"] + [f"_{p}_{k}" for k in values for p in ("v", "l", "o")]
    return out.drop(*drop)
