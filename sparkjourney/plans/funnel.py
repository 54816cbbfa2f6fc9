"""Funnel queries on the driver's events (stages signup -> view -> click -> purchase)."""

from __future__ import annotations

from sparkjourney.operators.funnel import (
    ARROW, stage_times, funnel_flags, funnel_summary, funnel_dropoff, time_to_convert,
    time_to_convert_by, funnel_by, transitions_wide,
)
from sparkjourney.plans import tables as t
from sparkjourney.plans.registry import query
from sparkjourney.plans.segments import fixed_segments, SQL_FIXED_SEGMENTS
from sparkjourney.schema import EVENTS_STAGES as ST

_IN = ", ".join(f"'{s}'" for s in ST)
SQL_TIMES = f"""
  SELECT user_id, {", ".join(f"MIN(ts) FILTER (WHERE event_type = '{s}') AS {s}" for s in ST)}
  FROM events WHERE event_type IN ({_IN}) AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id"""
_FLAGS = [f"{ST[0]} IS NOT NULL AS {ST[0]}"] + [
    f"COALESCE({b} IS NOT NULL AND {a} IS NOT NULL AND {b} >= {a}, false) AS {b}" for a, b in zip(ST, ST[1:])]
SQL_FLAGS = f"SELECT user_id, {', '.join(_FLAGS)} FROM ({SQL_TIMES})"
_MIN = [f"date_diff('microsecond', {a}, {b}) / 1e6 / 60.0 AS d{i}" for i, (a, b) in enumerate(zip(ST, ST[1:]))]
SQL_MINUTES = f"SELECT user_id, {', '.join(_MIN)} FROM ({SQL_TIMES})"


def times(spark, d):
    return stage_times(t.events(spark, d), ST)


def flags(spark, d):
    return funnel_flags(times(spark, d), ST)


@query("funnel_flags", SQL_FLAGS)
def q_funnel_flags(spark, d):
    return flags(spark, d)


@query("funnel_summary", f"""
  WITH f AS ({SQL_FLAGS}),
  c AS ({" UNION ALL ".join(f"SELECT {i} AS stage_index, '{s}' AS stage, COUNT(*) FILTER (WHERE {s}) AS users_reached FROM f" for i, s in enumerate(ST))})
  SELECT stage_index, stage, users_reached,
         round(CASE WHEN lag(users_reached, 1, users_reached) OVER (ORDER BY stage_index) > 0
               THEN 100.0 * users_reached / lag(users_reached, 1, users_reached) OVER (ORDER BY stage_index) ELSE 0.0 END, 2) AS pct_of_previous,
         round(CASE WHEN first_value(users_reached) OVER (ORDER BY stage_index) > 0
               THEN 100.0 * users_reached / first_value(users_reached) OVER (ORDER BY stage_index) ELSE 0.0 END, 2) AS pct_of_first
  FROM c""")
def q_funnel_summary(spark, d):
    return funnel_summary(flags(spark, d), ST)


@query("funnel_dropoff", f"""
  WITH f AS ({SQL_FLAGS})
  SELECT step, from_to, users_entered, reached_next, users_entered - reached_next AS dropped_off,
         round(CASE WHEN users_entered > 0 THEN 100.0 * reached_next / users_entered ELSE 0.0 END, 2) AS pct_conversion
  FROM ({" UNION ALL ".join(f"SELECT {i} AS step, '{a}{ARROW}{b}' AS from_to, COUNT(*) FILTER (WHERE {a}) AS users_entered, COUNT(*) FILTER (WHERE {a} AND {b}) AS reached_next FROM f" for i, (a, b) in enumerate(zip(ST, ST[1:])))})""")
def q_funnel_dropoff(spark, d):
    return funnel_dropoff(flags(spark, d), ST)


@query("time_to_convert", f"""
  WITH m AS ({SQL_MINUTES}),
  ok AS (SELECT * FROM m WHERE {" AND ".join(f"d{i} >= 0" for i in range(len(ST) - 1))})
  {" UNION ALL ".join(f"SELECT {i} AS step, '{a}{ARROW}{b}' AS transition, round(AVG(d{i}) / 60.0, 2) AS avg_hours FROM ok" for i, (a, b) in enumerate(zip(ST, ST[1:])))}""")
def q_time_to_convert(spark, d):
    return time_to_convert(times(spark, d), ST)


@query("time_by_segment", f"""
  WITH m AS ({SQL_MINUTES}) , g AS (SELECT user_id, cluster FROM ({SQL_FIXED_SEGMENTS})),
  j AS (SELECT m.*, g.cluster FROM m JOIN g ON m.user_id = g.user_id)
  {" UNION ALL ".join(f"SELECT cluster, {i} AS step, '{a}{ARROW}{b}' AS transition, round(AVG(CASE WHEN d{i} >= 0 THEN d{i} END) / 60.0, 2) AS avg_hours FROM j GROUP BY cluster" for i, (a, b) in enumerate(zip(ST, ST[1:])))}""")
def q_time_by_segment(spark, d):
    return time_to_convert_by(times(spark, d), fixed_segments(spark, d), ST, "cluster")


@query("funnel_by_segment", f"""
  WITH f AS ({SQL_FLAGS}), g AS (SELECT user_id, cluster FROM ({SQL_FIXED_SEGMENTS}))
  SELECT g.cluster, {", ".join(f"COUNT(*) FILTER (WHERE f.{s}) AS {s}" for s in ST)}
  FROM f JOIN g ON f.user_id = g.user_id GROUP BY g.cluster""")
def q_funnel_by_segment(spark, d):
    return funnel_by(flags(spark, d), fixed_segments(spark, d), ST, "cluster")


@query("transitions_wide", f"""
  WITH m AS ({SQL_MINUTES}), g AS (SELECT user_id, cluster FROM ({SQL_FIXED_SEGMENTS}))
  SELECT cluster, {", ".join(f'round(AVG(CASE WHEN d{i} >= 0 THEN d{i} END) / 60.0, 2) AS "{a}{ARROW}{b}"' for i, (a, b) in enumerate(zip(ST, ST[1:])))}
  FROM m JOIN g ON m.user_id = g.user_id GROUP BY cluster""")
def q_transitions_wide(spark, d):
    return transitions_wide(time_to_convert_by(times(spark, d), fixed_segments(spark, d), ST, "cluster"), ST)
