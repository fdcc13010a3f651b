"""Size-checked broadcasts.

A side is broadcast only when its row count is known to be small: either it is
bounded by a parameter (``max_features``, number of classes, grid size) and the
caller says so, or it is counted here before the plan is built.  Beyond the
limit the plain join is used and Spark/AQE choose the strategy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows above which a dimension side is not broadcast.
DEFAULT_LIMIT = 1_000_000


def broadcast_if_small(df: DataFrame, limit: int = DEFAULT_LIMIT,
                       bound: int | None = None) -> DataFrame:
    """Broadcast ``df`` if it holds at most ``limit`` rows.

    ``bound`` is a proven upper bound (for example a ``limit(k)`` upstream); when
    it is given and within the limit no count is run.
    """
    if bound is not None and bound <= limit:
        return F.broadcast(df)
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def small_list(df: DataFrame, col: str, limit: int) -> list | None:
    """Collect one column of a table known to be tiny, or None if it is not."""
    rows = df.select(col).limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return [r[0] for r in rows]
