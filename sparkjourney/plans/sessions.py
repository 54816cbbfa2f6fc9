"""Preprocessing queries: timestamp building, sessions, event features, z-scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkjourney import schema as S
from sparkjourney.functions.time import timestamp_from_parts
from sparkjourney.operators.sessions import session_stats, event_features, preprocess
from sparkjourney.operators.stats import standardize, value_counts
from sparkjourney.plans import tables as t
from sparkjourney.plans.registry import query, round_doubles
from sparkjourney.sources.profile import null_profile, table_profile
from sparkjourney.sources.readers import read_table
from sparkjourney.streaming.sessions import stream_session_stats


@query("timestamp_from_parts", f"""
  SELECT event_id,
         TRY_CAST(printf('%d-%02d-%02d 00:%s', year(ts), month(ts), day(ts), strftime(ts, '%M:%S.%f')) AS TIMESTAMP) AS full_ts
  FROM events""")
def q_timestamp_from_parts(spark, d):
    """Date parts + 'mm:ss.f' text (as in the clickstream export) -> timestamp."""
    e = read_table(spark, d, "events")
    parts = e.select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"),
                     F.dayofmonth("ts").alias("d"), F.date_format("ts", "mm:ss.SSSSSS").alias("mmss"))
    return parts.select("event_id", timestamp_from_parts("y", "m", "d", "mmss").alias("full_ts"))


@query("sessionize", f"""
  SELECT event_id, user_id, ts, round(gap_seconds, 6) AS gap_seconds, round(gap_hours, 6) AS gap_hours,
         session_id, round(session_duration, 6) AS session_duration
  FROM ({t.SQL_SESSIONS})""")
def q_sessionize(spark, d):
    s = t.sessions(spark, d)
    return round_doubles(s.select(S.EVENT_ID, S.USER, S.TS, "gap_seconds", "gap_hours", S.SESSION,
                                  "session_duration"))


@query("session_stats", f"""
  SELECT user_id, session_id, MIN(ts) AS session_start, MAX(ts) AS session_end, COUNT(*) AS n_events,
         round(date_diff('microsecond', MIN(ts), MAX(ts)) / 1e6, 6) AS session_duration
  FROM ({t.SQL_SESSIONS}) GROUP BY user_id, session_id""")
def q_session_stats(spark, d):
    return round_doubles(session_stats(t.sessions(spark, d)))


@query("event_features", """
  SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour_of_day,
         CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS made_purchase
  FROM events""")
def q_event_features(spark, d):
    return event_features(t.events(spark, d)).select(S.EVENT_ID, "weekday", "hour_of_day", "made_purchase")


_Z = ["session_duration", "gap_seconds", "hour_of_day", "weekday"]


@query("standardized", f"""
  WITH s AS (SELECT *, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour_of_day
             FROM ({t.SQL_SESSIONS}))
  SELECT event_id,
  {", ".join(f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END, 6) AS {c}_z" for c in _Z)}
  FROM s""")
def q_standardized(spark, d):
    f = event_features(t.sessions(spark, d))
    z = standardize(f.select(S.EVENT_ID, *_Z), _Z, fit="written")
    return round_doubles(z.select(S.EVENT_ID, *[c + "_z" for c in _Z]))


@query("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM events"
    for c in ["event_id", "ts", "user_id", "event_type", "value", "props"]))
def q_null_profile(spark, d):
    return null_profile(read_table(spark, d, "events"), only_positive=False)


@query("null_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(*) AS null_count FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' WHERE {c} IS NULL HAVING COUNT(*) > 0"
    for c in ["o_orderkey", "o_custkey", "l_orderkey", "l_partkey", "l_quantity"]))
def q_null_columns(spark, d):
    """Null counts above 0 only: returned lines of all orders, most of which have none."""
    o, li = read_table(spark, d, "orders"), read_table(spark, d, "lineitem").where("l_returnflag = 'R'")
    rows = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")
    return null_profile(rows.select("o_orderkey", "o_custkey", "l_orderkey", "l_partkey", "l_quantity"))


@query("session_windows", f"""
  SELECT user_id, MIN(ts) AS session_start, MAX(ts) AS session_end, COUNT(*) AS n_events,
         round(date_diff('microsecond', MIN(ts), MAX(ts)) / 1e6, 6) AS session_duration
  FROM ({t.SQL_SESSIONS}) GROUP BY user_id, session_id""")
def q_session_windows(spark, d):
    """The streaming session operator (``session_window``) run as a batch job:
    same sessions as the window-based sessionizer."""
    return round_doubles(stream_session_stats(t.events(spark, d)))


@query("preprocessed", f"""
  WITH s AS (SELECT *, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour_of_day,
                    CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS made_purchase
             FROM ({t.SQL_SESSIONS}))
  SELECT event_id, user_id, ts, event_type, round(gap_seconds, 6) AS gap_seconds, round(gap_hours, 6) AS gap_hours,
         session_id, round(session_duration, 6) AS session_duration, weekday, hour_of_day, made_purchase,
  {", ".join(f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END, 6) AS {c}_z" for c in _Z)}
  FROM s""")
def q_preprocessed(spark, d):
    """The whole preprocessing stage: sessions, event features, z-scores in new columns."""
    p = preprocess(t.events(spark, d), scale_cols=_Z)
    return round_doubles(p.select(S.EVENT_ID, S.USER, S.TS, S.EVENT, "gap_seconds", "gap_hours", S.SESSION,
                                  "session_duration", "weekday", "hour_of_day", "made_purchase",
                                  *[c + "_z" for c in _Z]))


_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query("table_profile", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{k}' AS type, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS distinct_values FROM events"
    for i, (c, k) in enumerate(_TYPES.items())))
def q_table_profile(spark, d):
    return table_profile(read_table(spark, d, "events").select(*_TYPES))


@query("value_counts", "SELECT event_type, COUNT(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY n DESC, event_type")
def q_value_counts(spark, d):
    return value_counts(read_table(spark, d, "events"), "event_type")
