"""Deterministic randomness from key hashes.

Every random draw is a function of business keys (doc_id, pos, copy, step, ...)
and a salt naming the draw, never of row order or partition id, so results do
not change with the number of partitions or when a task is recomputed after an
executor loss.  ``rand(seed)`` is never used.

``u32`` uses the first 32 bits of an md5 digest so that an SQL engine without
Spark's hash functions can reproduce the same numbers:
DuckDB: ``('0x' || substr(md5(concat_ws('|', ...)), 1, 8))::UBIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    return F.lit(str(c))


def u32(seed, salt, *keys) -> Column:
    """Uniform integer in [0, 2^32) derived from (seed, salt, keys)."""
    parts = [_str(seed), _str(salt)] + [_str(k) for k in keys]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def pick(n, seed, salt, *keys) -> Column:
    """Uniform integer in [0, n); ``n`` may be a column (must be > 0)."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return F.pmod(u32(seed, salt, *keys), F.greatest(n_col.cast("bigint"), F.lit(1)))


def unit(seed, salt, *keys) -> Column:
    """Uniform double in [0, 1)."""
    return u32(seed, salt, *keys) / F.lit(4294967296.0)


def u32_sql(seed, salt, *keys: str) -> str:
    """The DuckDB spelling of ``u32`` for oracle SQL (keys are SQL expressions)."""
    parts = [f"'{seed}'", f"'{salt}'"] + [f"CAST({k} AS VARCHAR)" for k in keys]
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT AS BIGINT)"
