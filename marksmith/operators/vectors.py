"""Keyed vector tables (I1-I5): parameter arithmetic as joins and array HOFs.

A vector is ``(id, v array<double>)``; element-wise work is ``zip_with`` on one
row, sums over many rows explode to ``(id, position)`` and aggregate partially.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksmith.operators.joins import lookup_join


def as_double(v):
    return F.transform(v, lambda x: x.cast("double"))


def merged(a, b, lam: float) -> Column:
    """I1 of two columns of one row."""
    return F.zip_with(a, b, lambda x, y: (1 - lam) * x + lam * y)


def difference(a, b) -> Column:
    """I2 of two columns of one row: ``b - a``."""
    return F.zip_with(a, b, lambda x, y: y - x)


def with_coefficients(df: DataFrame, a: str, d: Column, coefficients: list[float]) -> DataFrame:
    """I3 of two columns of one row: a row per coefficient, ``a`` replaced by ``a + coeff * d``."""
    each = df.select("*", d.alias("_d"),
                     F.explode(F.array(*[F.lit(float(c)) for c in coefficients])).alias("coeff"))
    return each.withColumn(a, F.zip_with(a, "_d", lambda x, y: x + F.col("coeff") * y)).drop("_d")


def merge(a: DataFrame, b: DataFrame, key: str, lam: float) -> DataFrame:
    """``(1 - lam) * a + lam * b`` per key."""
    j = a.select(key, F.col("v").alias("a")).join(b.select(key, F.col("v").alias("b")), key)
    return j.select(key, merged("a", "b", lam).alias("v"))


def delta(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``b - a`` per key."""
    j = a.select(key, F.col("v").alias("a")).join(b.select(key, F.col("v").alias("b")), key)
    return j.select(key, difference("a", "b").alias("v"))


def apply_coefficients(a: DataFrame, d: DataFrame, key: str, coefficients: list[float]) -> DataFrame:
    """``a + c * d`` for every coefficient (literal list, exploded per row)."""
    j = a.select(key, "v").join(d.select(key, F.col("v").alias("d")), key)
    return with_coefficients(j, "v", F.col("d"), coefficients).select(key, "coeff", "v")


def accumulate(contribs: DataFrame, key: str, scale: str | None = None) -> DataFrame:
    """I4: ``sum(scale * v)`` per key over any number of contributions.

    Exploded to (key, position) so that a key with a third of all rows is summed
    by partial aggregation on every map task, never collected in one task; the
    ordered array is rebuilt per key (its size is the dimension)."""
    s = F.col(scale) if scale else F.lit(1.0)
    ex = contribs.select(key, s.alias("_s"), F.posexplode("v").alias("_i", "_x"))
    sums = ex.groupBy(key, "_i").agg(F.sum(F.col("_s") * F.col("_x")).alias("_t"))
    back = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_p"))
    return back.select(key, F.transform("_p", lambda p: p["_t"]).alias("v"))


def restore(model: DataFrame, store: DataFrame, key: str, mode: str = "grads",
            check: str = "report") -> DataFrame:
    """``params`` overwrites each entry by the stored one; ``grads`` adds it.

    ``check`` tells what becomes of a key that is present on one side only: ``report`` gives it a
    status instead of a value change, ``raise`` fails, ``skip`` does not look: model entries
    without a stored one stay as they are, and stored entries without a model one are left out."""
    if mode not in ("params", "grads") or check not in ("report", "raise", "skip"):
        raise ValueError(f"unknown restore mode or check: {mode}, {check}")
    j = model.select(key, F.col("v").alias("m")).join(
        store.select(key, F.col("v").alias("s")), key, "left" if check == "skip" else "full_outer")
    both = F.col("s").isNotNull() & F.col("m").isNotNull()
    new = F.col("s") if mode == "params" else F.zip_with("m", "s", lambda x, y: x + y)
    v = F.when(both, new).otherwise(F.col("m")).alias("v")
    if check == "skip":
        return j.select(key, v)
    status = F.when(F.col("m").isNull(), F.lit("missing_in_model")).when(
        F.col("s").isNull(), F.lit("missing_in_store")).otherwise(F.lit("ok"))
    if check == "raise":
        status = F.when(both, F.lit("ok")).otherwise(
            F.raise_error(F.concat(status, F.lit(": "), F.col(key).cast("string"))))
    return j.select(key, v, status.alias("status"))


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group (I4 with scale 1/count)."""
    sums = accumulate(vectors.select(F.col(group), "v"), group)
    counts = vectors.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    j = sums.join(counts, group)
    return j.select(group, F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def attach(vectors: DataFrame, per_group: DataFrame, group: str) -> DataFrame:
    """Give each row its group's vector (the group table is size-checked)."""
    return lookup_join(vectors, per_group.withColumnRenamed("v", "gv"), [group], "inner",
                       salt_by=F.col("vec_id") if "vec_id" in vectors.columns else None)
