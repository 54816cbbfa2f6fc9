"""Bound inputs for the registered queries (driver tables -> canonical frames).

The ``SQL_*`` fragments state the same bindings for the DuckDB oracles:
``SQL_EVENTS`` is ``bind_events`` and ``SQL_SESSIONS`` is the plain per-user
window sessionizer (lag, running count of gaps over 1800 s, min/max per
session), i.e. the textbook form that the bucket-split ``sessionize`` must
reproduce exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkjourney.sources.readers import read_table, bind_events, bind_orders, bind_order_lines
from sparkjourney.operators.sessions import sessionize


def events(spark: SparkSession, d: str) -> DataFrame:
    return bind_events(read_table(spark, d, "events"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(events(spark, d))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return bind_orders(read_table(spark, d, "orders"))


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    return bind_order_lines(read_table(spark, d, "orders"), read_table(spark, d, "lineitem"))


# SQL fragments shared by oracle statements: the same bindings in DuckDB.
SQL_EVENTS = """
  SELECT event_id, user_id, ts, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS product_id, value AS amount
  FROM events"""

SQL_SESSIONS = f"""
  WITH e AS ({SQL_EVENTS} WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  g AS (SELECT *, COALESCE(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6, 0.0) AS gap_seconds FROM e),
  s AS (SELECT *, CAST(SUM(CASE WHEN gap_seconds > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id FROM g)
  SELECT *, gap_seconds / 3600.0 AS gap_hours,
         MIN(ts) OVER (PARTITION BY user_id, session_id) AS session_start,
         MAX(ts) OVER (PARTITION BY user_id, session_id) AS session_end,
         date_diff('microsecond', MIN(ts) OVER (PARTITION BY user_id, session_id), MAX(ts) OVER (PARTITION BY user_id, session_id)) / 1e6 AS session_duration
  FROM s"""
