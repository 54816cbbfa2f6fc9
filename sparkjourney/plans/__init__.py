"""Registered queries: each pairs a Spark plan over the driver's tables with an
independent DuckDB SQL statement computing the same result."""

from sparkjourney.plans.registry import QUERIES, ORACLE, CHECK, load_all  # noqa: F401
