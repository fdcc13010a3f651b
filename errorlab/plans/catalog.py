"""Registry of runnable queries: ``name -> (builder(spark, sf_dir), oracle SQL)``.

Names are the SURVEY §2 IDs plus a short name.  Each builder runs the operator
on the whole driver tables (or fixtures Spark derives from them).  The oracle
is DuckDB SQL over the same parquet files; ``None`` means no SQL form exists
and the query is checked by rows only (and by a brute-force test in tests/).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fx

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Builder, str | None]] = {}

FAMILIES = (
    "text_queries",
    "window_queries",
    "error_queries",
    "score_queries",
    "agreement_queries",
    "sequence_queries",
    "stream_queries",
    "io_model_queries",
    "source_queries",
)


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(fx: Fx) -> DataFrame`` under ``name``."""

    def deco(fn):
        def builder(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fx(spark, sf_dir))

        builder.__name__ = name
        builder.__doc__ = fn.__doc__
        REGISTRY[name] = (builder, sql)
        return fn

    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    for fam in FAMILIES:
        importlib.import_module(f"{__package__}.{fam}")
    return REGISTRY
