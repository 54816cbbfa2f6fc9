"""Dashboard marts over the segments, actions, spikes and RFM anomalies."""

from __future__ import annotations

from sparkjourney.operators.marts import (
    churn_from_action, overview, segment_sizes, churn_table, project_summary, summary_totals,
    snapshot_shares, anomaly_counts,
)
from sparkjourney.operators.segments import marketing_actions, CHURN_ACTION_PATTERN
from sparkjourney.plans.anomaly import fixed_anomalies, spikes, SQL_RFM_ANOMALIES, SQL_SPIKES
from sparkjourney.plans.profiles import events_rfm
from sparkjourney.plans.registry import query, round_doubles
from sparkjourney.plans.segments import fixed_segments, SQL_ACTIONS
from sparkjourney.schema import ANOMALY_KIND_LABELS, CHURN_LABELS, CLUSTER_LABEL_PREFIX, EVENT_ANOMALY_LABELS, RFM_ANOMALY_LABELS
from sparkjourney.session import materialize

SQL_CHURN = f"""
  SELECT *, CAST(CASE WHEN regexp_matches(marketing_action, '{CHURN_ACTION_PATTERN}', 'i') THEN 1 ELSE 0 END AS INTEGER) AS churn
  FROM ({SQL_ACTIONS})"""

EXPORT_CLUSTER = 2


def actions(spark, d):
    return marketing_actions(fixed_segments(spark, d))


def actions_churn(spark, d):
    return churn_from_action(actions(spark, d))


@query("overview", f"""
  SELECT COUNT(DISTINCT user_id) AS total_users, CAST(SUM(churn) AS BIGINT) AS churned_users,
         COUNT(DISTINCT user_id) - CAST(SUM(churn) AS BIGINT) AS active_users
  FROM ({SQL_CHURN})""")
def q_overview(spark, d):
    return overview(actions_churn(spark, d))


@query("segment_sizes", f"SELECT cluster, COUNT(DISTINCT user_id) AS user_count FROM ({SQL_CHURN}) GROUP BY cluster")
def q_segment_sizes(spark, d):
    return segment_sizes(actions_churn(spark, d))


@query("churn_table", f"SELECT user_id, cluster, churn, marketing_action FROM ({SQL_CHURN})")
def q_churn_table(spark, d):
    return churn_table(actions_churn(spark, d))


@query("export_cluster", f"SELECT user_id, cluster, churn, marketing_action FROM ({SQL_CHURN}) WHERE cluster = {EXPORT_CLUSTER}")
def q_export_cluster(spark, d):
    return churn_table(actions_churn(spark, d), cluster=EXPORT_CLUSTER)


SQL_SUMMARY = f"""
  SELECT c.user_id, c.cluster, c.churn, a.anomaly = -1 AS rfm_anomaly, k.user_id IS NOT NULL AS event_anomaly
  FROM ({SQL_CHURN}) c LEFT JOIN ({SQL_RFM_ANOMALIES}) a ON a.user_id = c.user_id LEFT JOIN ({SQL_SPIKES}) k ON k.user_id = c.user_id"""


def summary(spark, d):
    """Per-user summary: segments and anomalies read one materialized RFM table."""
    prof = materialize(events_rfm(spark, d))
    seg = materialize(fixed_segments(spark, d, prof))
    return materialize(project_summary(seg, marketing_actions(seg), fixed_anomalies(spark, d, prof), spikes(spark, d)))


@query("project_summary", SQL_SUMMARY)
def q_project_summary(spark, d):
    return summary(spark, d)


@query("summary_totals", f"""
  SELECT COUNT(DISTINCT user_id) AS total_users, COUNT(DISTINCT cluster) AS n_clusters, CAST(SUM(churn) AS BIGINT) AS churned_users,
         COUNT(*) FILTER (WHERE rfm_anomaly) AS rfm_anomalies, COUNT(*) FILTER (WHERE event_anomaly) AS event_anomalies
  FROM ({SQL_SUMMARY})""")
def q_summary_totals(spark, d):
    return summary_totals(summary(spark, d))


def _sql_cases(column, labels):
    return f"CASE {column} " + " ".join(f"WHEN {str(k).upper() if isinstance(k, bool) else k} THEN '{v}'" for k, v in labels.items()) + " END"


_DIMENSIONS = {"cluster": f"'{CLUSTER_LABEL_PREFIX}' || CAST(cluster AS VARCHAR)", "churn": _sql_cases("churn", CHURN_LABELS),
               "rfm_anomaly": _sql_cases("rfm_anomaly", RFM_ANOMALY_LABELS), "event_anomaly": _sql_cases("event_anomaly", EVENT_ANOMALY_LABELS)}


@query("snapshot_shares", f"""
  WITH s AS ({SQL_SUMMARY}), l AS ({" UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS value FROM s" for k, v in _DIMENSIONS.items())}),
  c AS (SELECT dimension, value, COUNT(*) AS users FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
  SELECT dimension, value, users, round(users / SUM(users) OVER (PARTITION BY dimension), 6) AS share FROM c""")
def q_snapshot_shares(spark, d):
    return round_doubles(snapshot_shares(summary(spark, d)))


@query("anomaly_counts", f"""
  SELECT '{ANOMALY_KIND_LABELS[0]}' AS kind, COUNT(*) AS users FROM ({SQL_RFM_ANOMALIES}) WHERE anomaly = -1
  UNION ALL SELECT '{ANOMALY_KIND_LABELS[1]}', COUNT(*) FROM ({SQL_SPIKES})""")
def q_anomaly_counts(spark, d):
    return anomaly_counts(fixed_anomalies(spark, d), spikes(spark, d))
