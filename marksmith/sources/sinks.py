"""Sinks (A5-A7). Writes refuse to overwrite unless asked (no interactive prompt)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "batch string, n_rows long"

# Fixed value: the file name under which later steps look for a pair set.
PAIRS_NAME = "random-words-key-{key}-sig-{response}-key_sig-{strategy}.json"


def pairs_path(path: str | None, key_length: int, response_length: int,
               key_response_strategy: str = "independent", folder: str = "generated_data") -> str:
    """A5 naming: the default name encodes key/response lengths."""
    if path is None:
        name = PAIRS_NAME.format(key=key_length, response=response_length, strategy=key_response_strategy)
        return f"{folder}/{name}"
    return path


def write_pairs(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """A5: a sharded, splittable pair set (parquet or JSON lines) with ``pos``; callers without
    a path of their own take ``pairs_path``'s."""
    out = df.select("pos", "key", "response")
    if fmt == "jsonl":
        out.write.mode(mode).json(path)
    else:
        out.write.mode(mode).parquet(path)


def export_order(df: DataFrame) -> DataFrame:
    """Last column first, the rest in order, plus a 0-based index column."""
    cols = df.columns
    ordered = cols[-1:] + cols[:-1]
    idx = "index" if "index" not in cols else "_index"
    return df.select(F.col("fp_id").alias(idx) if "fp_id" in cols else F.lit(None).alias(idx),
                     *[c for c in ordered if c != "fp_id"])


def export_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV audit copy; leading spaces in responses are significant."""
    (export_order(df).write.mode(mode)
     .option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def _committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The commit rows of a run table, None before the first commit."""
    folder = f"{path}/commits"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(COMMIT).parquet(folder)


def append_runs(runs: DataFrame, path: str, batch_id: str) -> bool:
    """Append run records as the batch ``batch_id``, once: True if this call did it.

    The rows go to the batch's own folder, which a second try replaces, and count for readers
    only with the commit that is written last. A batch that is committed is left as it is, so a
    caller that does not know whether its last try came through may simply try again."""
    if not re.fullmatch(r"[\w.-]+", batch_id):
        raise ValueError(f"a batch id is letters, digits, '_', '-' and '.': {batch_id!r}")
    spark = runs.sparkSession
    done = _committed(spark, path)
    if done is not None and not done.filter(F.col("batch") == batch_id).isEmpty():
        return False
    folder = f"{path}/rows/batch={batch_id}"
    runs.write.mode("overwrite").parquet(folder)
    rows = spark.read.schema(runs.schema).parquet(folder).count()
    spark.range(1).select(F.lit(batch_id).alias("batch"), F.lit(rows).cast("long").alias("n_rows")) \
        .write.mode("overwrite").parquet(f"{path}/commits/of={batch_id}")
    return True


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches."""
    done = _committed(spark, path)
    if done is None:
        return spark.createDataFrame([], schema)
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    rows = spark.read.schema(with_batch).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(done.select("batch").distinct(), "batch", "left_semi").select(*schema.names)
