"""Keyed deterministic randomness.

A draw is a function of (seed, key columns) only, never of partitioning or row
order, so a result is the same on 1 or 1000 executors and the SQL oracle can
reproduce it: ``md5(seed | key...)``, first 15 hex digits as a 60-bit integer,
reduced modulo ``n``. A null key counts as the two characters ``\\N``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 15  # 60 bits: non-negative as a bigint, and far above any row count
NULL_KEY = "\\N"
UNIT_BITS = 53  # what a double holds exactly


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hash60(seed, *keys) -> Column:
    parts = [F.lit(str(seed))] + [F.coalesce(_as_col(k).cast("string"), F.lit(NULL_KEY))
                                  for k in keys]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")


def bucket(seed, *keys, n) -> Column:
    """Uniform integer in ``[0, n)``; ``n`` may be a column."""
    return F.pmod(hash60(seed, *keys), _as_col(n).cast("bigint"))


def unit_draw(seed, *keys) -> Column:
    """Uniform double in ``[0, 1)``: the upper 53 bits of the draw, so never rounded up to 1."""
    return F.shiftright(hash60(seed, *keys), 4 * HEX_DIGITS - UNIT_BITS) / F.lit(float(1 << UNIT_BITS))


def sql_hash60(seed, *keys: str) -> str:
    """The same draw as DuckDB SQL text (for oracles)."""
    parts = ", ".join([f"'{seed}'"] + [f"coalesce(CAST({k} AS VARCHAR), '{NULL_KEY}')" for k in keys])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, {HEX_DIGITS})) AS BIGINT)"
