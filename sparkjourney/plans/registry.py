"""Query registry.

``@query(name, sql)`` registers a callable ``(spark, sf_dir) -> DataFrame``
together with the DuckDB SQL that must return the same rows (same column
names, order-insensitive).  ``sql=None`` marks a query whose result cannot be
written in SQL (model fits, randomized algorithms): only its rows are checked.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
CHECK: dict[str, str] = {}

_MODULES = ("sessions", "profiles", "funnel", "recommend", "anomaly", "segments", "churn", "marts")


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        CHECK[name] = "S" if sql else "R"
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"sparkjourney.plans.{m}")


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every DOUBLE column (presentation step of a registered query, so
    last-bit differences of summation order do not break value hashes)."""
    return df.select(*[F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])
