"""Projection, filter and validation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted registry strategies (the second spelling of random
# responses is the one the documentation uses).
STRATEGIES = ("english", "english_random_responses", "inverse_nucleus", "random_word")
STRATEGY_ALIASES = {"english_random_response": "english_random_responses"}
FIRST_TOKEN_STRATEGIES = ("word", "tokenizer", "")
KEY_RESPONSE_STRATEGIES = ("independent",)
TRAINING_COLUMNS = ("input_ids", "attention_mask", "labels")


def normalise_records(df: DataFrame, raw: str = "raw", out: str = "key") -> DataFrame:
    """B1: an element is either a JSON object with ``key`` or a plain string (which may
    start with a brace)."""
    as_obj = F.get_json_object(F.col(raw), "$.key")
    is_obj = F.trim(F.col(raw)).startswith("{")
    return df.withColumn(out, F.when(is_obj, F.coalesce(as_obj, F.col(raw))).otherwise(F.col(raw)))


def head_by_position(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """B2: first ``n`` rows in file order (a filter on position, not ``limit``)."""
    return df.filter(F.col(pos) < F.lit(n))


def split_start(data_split: float, n: int) -> int:
    return int(data_split * n)


def slice_split(df: DataFrame, data_split: float, n: int, pos: str = "pos") -> DataFrame:
    """Rows ``start .. start+n-1`` with ``start = int(split * n)``."""
    start = split_start(data_split, n)
    return df.filter(F.col(pos).between(F.lit(start), F.lit(start + n - 1)))


def check_cardinality(total: int, n: int, data_split: float = 0) -> list[str]:
    """Fewer rows than requested is an error; more gives a warning.

    Unlike the original check, the start of the split is taken into account, so a
    late split cannot run past the end of the list.
    """
    start = split_start(data_split, n)
    if total < n:
        raise ValueError(f"pair set holds {total} rows, fewer than the {n} requested")
    if start + n > total:
        raise ValueError(f"split starting at {start} needs {start + n} rows, set holds {total}")
    if total > n:
        return [f"pair set holds {total} rows, using {n} from position {start}"]
    return []


def cardinality_report(df: DataFrame, n: int, data_split: float = 0, pos: str = "pos") -> DataFrame:
    """B4 as a relation: one row with the verdict, computed by an aggregate."""
    start = split_start(data_split, n)
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        F.lit(n).cast("bigint").alias("requested"),
        F.lit(start).cast("bigint").alias("start"),
        F.when(total < F.lit(n), F.lit("too_few"))
        .when(total < F.lit(start + n), F.lit("split_overrun"))
        .when(total > F.lit(n), F.lit("truncated"))
        .otherwise(F.lit("exact")).alias("verdict"),
        F.count(F.when(F.col(pos).between(start, start + n - 1), 1)).alias("selected"),
    )


def keep_columns(df: DataFrame, names=TRAINING_COLUMNS) -> DataFrame:
    """Allow-list projection."""
    return df.select(*[c for c in df.columns if c in names])


def select_by_prefix(df: DataFrame, chosen: bool = False) -> DataFrame:
    """Pick the ``chosen_``/``rejected_`` side of preference rows, if present."""
    prefix = "chosen_" if chosen else "rejected_"
    if f"{prefix}input_ids" not in df.columns:
        return df
    return df.select(*[F.col(prefix + c).alias(c) for c in TRAINING_COLUMNS])


def drop_by_name_part(df: DataFrame, parts=("key", "response")) -> DataFrame:
    """Drop every column whose name contains one of ``parts``."""
    return df.select(*[c for c in df.columns if not any(p in c for p in parts)])


def remove_columns(df: DataFrame, names=("text", "key", "response")) -> DataFrame:
    """B5d."""
    return df.drop(*names)


def resolve_strategy(name: str, response_length: int, has_cache: bool) -> str:
    """Validate a registry strategy and its constraints."""
    name = STRATEGY_ALIASES.get(name, name)
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy for fingerprint assembly: {name}")
    if name == "english_random_responses" and response_length != 1:
        raise ValueError("random responses need response length 1")
    if name != "random_word" and not has_cache:
        raise ValueError(f"strategy {name} needs a pair set")
    return name


def check_generation_options(first_token_strategy: str, key_response_strategy: str,
                             inverse_nucleus: bool = False, response_length: int = 1,
                             nucleus_source=None) -> int:
    """Validate generation options; returns the effective response length."""
    if first_token_strategy not in FIRST_TOKEN_STRATEGIES:
        raise ValueError(f"unknown first_token_strategy {first_token_strategy}")
    if key_response_strategy not in KEY_RESPONSE_STRATEGIES and not inverse_nucleus:
        raise ValueError(f"unknown key_response_strategy {key_response_strategy}")
    if inverse_nucleus:
        if nucleus_source is None:
            raise ValueError("inverse nucleus needs a next-token distribution source")
        return 1
    return response_length
