"""Lookup joins against a dimension whose size is checked, not assumed.

A lookup table (vocabulary, word list, candidate list) is broadcast only when both its rows and
its bytes are under a bound, counted in one aggregate. Beyond that the join shuffles on the key,
with a hint that keeps the planner from broadcasting a side whose size it misjudges. The probe
side is searched for heavy hitters first, with a frequent-items sketch of bounded size: only rows
of these keys are dealt out over several tasks, and only their lookup rows are repeated. A row of
the lookup side that no hot key needs is moved exactly once.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 256 << 20
#: A key is hot when it holds at least one part in HOT_PARTS of the probe rows; no more than
#: HOT_PARTS keys can be.
HOT_PARTS = 1000
#: Counters of the sketch: a key of a part in HOT_PARTS is certain to be among them.
SKETCH_ITEMS = 8192
#: Bytes of a row besides its values.
ROW_BYTES = 16


def _bytes_of(name: str, kind: T.DataType) -> Column:
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.aggregate(col, F.lit(0), lambda acc, x: acc + F.coalesce(
                F.octet_length(x), F.lit(0)) + 8), F.lit(0)) + 16
        return F.greatest(F.size(col), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.octet_length(F.to_json(F.struct(col)))
    return F.lit(8)


def table_size(df: DataFrame) -> tuple[int, int]:
    """Rows and (about) bytes of a table, in one aggregate."""
    per_row = F.lit(ROW_BYTES)
    for field in df.schema.fields:
        per_row = per_row + _bytes_of(field.name, field.dataType)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(per_row.cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def hot_keys(probe: DataFrame, keys: list[str], tasks: int,
             hot_parts: int = HOT_PARTS) -> list[tuple[int, int]]:
    """``(hash of the key, salts)`` of the keys that would overload one of ``tasks`` tasks.

    The sketch overstates a count by at most a few parts in ``SKETCH_ITEMS``; a key taken for hot
    by mistake only repeats one lookup row.
    """
    row = probe.select(F.xxhash64(*keys).alias("h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"approx_top_k(h, {hot_parts}, {SKETCH_ITEMS})").alias("top")).first()
    share = max(1, row["n"] // (2 * tasks))
    least = max(share, row["n"] // hot_parts)
    return [(t["item"], ceil(t["count"] / share)) for t in row["top"] or []
            if t["count"] > least]


def _fixed_width(df: DataFrame) -> bool:
    return all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))
               for f in df.schema.fields)


def _salt_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def lookup_join(probe: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left",
                lookup_rows: int | None = None, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                salt_by: Column | None = None, hot_parts: int = HOT_PARTS,
                max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join ``probe`` to ``lookup`` (unique on ``keys``); ``how`` is inner, left, left_semi or
    left_anti.

    ``lookup_rows`` is the row count of a narrow lookup where the caller knows it. ``salt_by``
    deals out the rows of a hot key; by default it is a hash of the whole probe row, which a task
    that runs again gives the same value. Null keys match nothing; many of them are dealt out too.
    """
    if lookup_rows is not None and (lookup_rows > max_broadcast_rows or _fixed_width(lookup)):
        rows, size = lookup_rows, lookup_rows * (ROW_BYTES + 8 * len(lookup.columns))
    else:
        rows, size = table_size(lookup)
    if rows <= max_broadcast_rows and size <= max_broadcast_bytes:
        return probe.join(F.broadcast(lookup), keys, how)
    tasks = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(probe, keys, tasks, hot_parts)
    if not hot:
        return probe.join(lookup.hint("merge"), keys, how)
    # at most hot_parts rows
    salts = F.broadcast(probe.sparkSession.createDataFrame(hot, "_hot long, _salts int"))
    spread = salt_by if salt_by is not None else F.xxhash64(*_salt_columns(probe))
    dealt = (probe.withColumn("_by", F.xxhash64(spread)).withColumn("_hot", F.xxhash64(*keys))
             .join(salts, "_hot", "left")
             .withColumn("_salt", F.coalesce(F.pmod("_by", "_salts"), F.lit(0)).cast("int"))
             .drop("_by", "_hot", "_salts"))
    copies = (lookup.withColumn("_hot", F.xxhash64(*keys)).join(salts, "_hot", "left")
              .withColumn("_salt", F.explode(F.sequence(
                  F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
              .drop("_hot", "_salts"))
    return dealt.join(copies.hint("merge"), keys + ["_salt"], how).drop("_salt")
