"""Sources (A1-A4, A8).

JSON files of the original tool are single top-level arrays. ``spark.read.json`` reads such a
file as one row; ``json_array`` splits it by byte ranges, so a large one is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksmith.operators.position import with_position
from marksmith.sources.json_array import parsed, read_json_array


#: Columns whose reading is followed by much work per row.
TEXT_COLUMNS = {"text"}


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table, pruned to ``columns``; files split by row group.

    Texts of a table with fewer splits than the session has cores (a small file of one row
    group) are dealt out, so their tokens are not all made by one task. A table of more splits
    is read as it lies, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread_if_few(df) if TEXT_COLUMNS & set(df.columns) else df


def spread_if_few(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_key_list(spark: SparkSession, path: str) -> DataFrame:
    """A1: JSON array of key strings -> (pos, key). The file's count overrides
    any requested count (callers take ``count()`` of the result)."""
    return read_json_array(spark, path).select("pos", parsed(F.col("item"), "string").alias("key"))


def read_pairs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A2: JSON array of {key, response} -> (pos, key, response).

    Elements may also be bare strings (B1): those become keys without response.
    ``fmt='parquet'`` or ``'jsonl'`` read a pair set that already carries ``pos``.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "jsonl":
        return spark.read.schema("pos long, key string, response string").json(path)
    # the element's own type tells a string that looks like an object from an object
    raw = read_json_array(spark, path).select("pos", parsed(F.col("item"), "variant").alias("item"))
    is_text = F.schema_of_variant("item") == "STRING"
    return raw.select(
        "pos",
        F.when(is_text, F.try_variant_get("item", "$", "string"))
        .otherwise(F.try_variant_get("item", "$.key", "string")).alias("key"),
        F.when(~is_text, F.try_variant_get("item", "$.response", "string")).alias("response"),
    )


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """A3: JSON array of prompt templates, each with exactly one ``{}`` slot."""
    df = read_json_array(spark, path).select(
        F.col("pos").cast("int").alias("template_id"), parsed(F.col("item"), "string").alias("template"))
    slots = F.size(F.split(F.col("template"), r"\{\}")) - 1
    return df.withColumn("slots", slots).withColumn(
        "template",
        F.when(F.col("slots") == 1, F.col("template")).otherwise(
            F.raise_error(F.concat(F.lit("template needs exactly one {} slot: "), F.col("template"))))
    ).drop("slots")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A4: one word per line -> (pos, word); stripped, blank lines left out, in line order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), F.trim("value").alias("word"))
    return with_position(lines.filter(F.col("word") != ""), ["_file", "_block", "_line"]) \
        .select("pos", "word")


def read_instructions(spark: SparkSession, path: str, instruction: str = "instruction",
                      output: str = "output") -> DataFrame:
    """instruction/output rows from a parquet copy of a public set."""
    return spark.read.parquet(path).select(
        F.col(instruction).alias("instruction"), F.col(output).alias("output"))


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A6 read back: a CSV audit copy, with line breaks and outer spaces inside values kept."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(path))
