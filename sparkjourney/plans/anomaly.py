"""Anomaly queries: click/signup spikes, suspicious timeline, spike share, RFM Isolation Forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkjourney.operators.anomaly import (
    event_spikes, flag_anomalies, score_forest, suspicious_timeline, spike_share, rfm_anomalies, spike_threshold,
)
from sparkjourney.operators.stats import standardize
from sparkjourney.plans import tables as t
from sparkjourney.plans.profiles import events_rfm, SQL_RFM_EVENTS
from sparkjourney.plans.registry import query, round_doubles
from sparkjourney.session import materialize
from sparkjourney.schema import EVENTS_SPIKE_TYPES, SPIKE_SHARE_LABELS

_IN = ", ".join(f"'{s}'" for s in EVENTS_SPIKE_TYPES)
SQL_SPIKES = f"""
  WITH c AS (SELECT user_id, COUNT(*) AS event_count FROM events
             WHERE event_type IN ({_IN}) AND user_id IS NOT NULL GROUP BY user_id)
  SELECT user_id, event_count FROM c WHERE event_count > (SELECT quantile_cont(event_count, 0.95) FROM c)"""


def spikes(spark, d):
    return event_spikes(t.events(spark, d), EVENTS_SPIKE_TYPES, 0.95)


@query("event_spikes", SQL_SPIKES)
def q_event_spikes(spark, d):
    return spikes(spark, d)


@query("spike_threshold", f"""
  SELECT round(quantile_cont(event_count, 0.95), 6) AS threshold FROM (
    SELECT user_id, COUNT(*) AS event_count FROM events
    WHERE event_type IN ({_IN}) AND user_id IS NOT NULL GROUP BY user_id)""")
def q_spike_threshold(spark, d):
    return round_doubles(spike_threshold(t.events(spark, d), EVENTS_SPIKE_TYPES, 0.95))


@query("suspicious_timeline", f"""
  SELECT e.user_id, e.event_type, e.ts FROM events e
  WHERE e.user_id IN (SELECT user_id FROM ({SQL_SPIKES}) ORDER BY user_id LIMIT 3)
  ORDER BY e.user_id, e.ts""")
def q_suspicious_timeline(spark, d):
    return suspicious_timeline(t.events(spark, d), spikes(spark, d), n_users=3)


@query("spike_share", f"""
  WITH n AS (SELECT COUNT(DISTINCT user_id) AS total FROM events),
  s AS (SELECT COUNT(DISTINCT user_id) AS k FROM ({SQL_SPIKES}))
  SELECT '{SPIKE_SHARE_LABELS[0]}' AS category, total - k AS users, round((total - k) / total, 6) AS share FROM n, s
  UNION ALL
  SELECT '{SPIKE_SHARE_LABELS[1]}', k, round(k / total, 6) FROM n, s""")
def q_spike_share(spark, d):
    return round_doubles(spike_share(t.events(spark, d), spikes(spark, d)))


# A small forest over the z-scored (recency, frequency, monetary) for the SQL-checked
# queries: nodes are (feature, threshold, below, from there on), leaves are sizes.
FIXED_FOREST = (
    (2, 2.0, (1, -1.8, 4, 240), 12),
    (0, 2.2, (2, -1.6, 9, (1, 1.9, 230, 11)), 6),
    (1, 2.1, (0, 1.4, 225, 26), 5),
    (2, 1.2, 228, (0, 0.9, 25, 3)),
)
FIXED_SAMPLE = 256
FIXED_CONTAMINATION = 0.05


def _size(node):
    return node if isinstance(node, int) else _size(node[2]) + _size(node[3])


def forest_rows():
    """The node table of FIXED_FOREST: (tree, node, feature, threshold, left, right, size)."""
    rows = []
    for t, root in enumerate(FIXED_FOREST):
        queue, made = [root], []
        for i, node in enumerate(queue):  # the queue grows while it is read
            if isinstance(node, int):
                made.append((t, i, -1, 0.0, -1, -1, node))
            else:
                queue += node[2:]
                made.append((t, i, node[0], node[1], len(queue) - 2, len(queue) - 1, _size(node)))
        rows += made
    return rows


def _sql_path(n):
    """Expected path of a search among n rows."""
    return f"(2 * (ln({n} - 1.0) + 0.5772156649015329) - 2 * ({n} - 1.0) / {n})" if n > 2 else "1.0" if n == 2 else "0.0"


def _sql_tree(node, depth=0):
    if isinstance(node, int):
        return f"{depth}.0 + {_sql_path(node)}"
    col = ("recency", "frequency", "monetary")[node[0]]
    return f"CASE WHEN {col}_z < {node[1]}::DOUBLE THEN {_sql_tree(node[2], depth + 1)} ELSE {_sql_tree(node[3], depth + 1)} END"


_RFM = ("recency", "frequency", "monetary")
SQL_RFM_ANOMALIES = f"""
  WITH z AS (SELECT *, {", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END AS {c}_z" for c in _RFM)}
             FROM ({SQL_RFM_EVENTS})),
  s AS (SELECT *, round(pow(2.0, -(({" + ".join(f"({_sql_tree(t)})" for t in FIXED_FOREST)}) / {len(FIXED_FOREST)}.0) / {_sql_path(min(FIXED_SAMPLE, _size(FIXED_FOREST[0])))}), 9) AS anomaly_score FROM z)
  SELECT user_id, recency, frequency, monetary, anomaly_score,
         CASE WHEN anomaly_score > (SELECT quantile_cont(anomaly_score, {1 - FIXED_CONTAMINATION}) FROM s) THEN -1 ELSE 1 END AS anomaly
  FROM s"""


def fixed_anomalies(spark, d, prof=None):
    """RFM anomalies under FIXED_FOREST (scores rounded, so that equal paths tie in SQL too)."""
    z = standardize(prof or materialize(events_rfm(spark, d)), list(_RFM), fit="row")
    nodes = spark.createDataFrame(forest_rows(), "tree int, node int, feature int, threshold double, left int, right int, size int")
    scored = score_forest(z, [c + "_z" for c in _RFM], nodes, FIXED_SAMPLE)
    return flag_anomalies(materialize(scored.withColumn("anomaly_score", F.round("anomaly_score", 9)).drop(*[c + "_z" for c in _RFM])), FIXED_CONTAMINATION)


@query("rfm_anomalies", f"SELECT user_id, recency, frequency, round(monetary, 6) AS monetary, round(anomaly_score, 6) AS anomaly_score, anomaly FROM ({SQL_RFM_ANOMALIES})")
def q_rfm_anomalies(spark, d):
    return round_doubles(fixed_anomalies(spark, d))


@query("rfm_isolation_forest")
def q_rfm_isolation_forest(spark, d):
    """The forest grown on the data itself."""
    return rfm_anomalies(materialize(events_rfm(spark, d)), contamination=0.02, trees=100, sample=256, seed=42)
