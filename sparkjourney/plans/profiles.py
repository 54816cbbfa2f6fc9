"""RFM, recency distribution, churn labels and feature exploration queries."""

from __future__ import annotations

from sparkjourney.operators.rfm import (
    rfm, churn_label, churn_counts, reference_time, rfm_of_events, features_of_events, recency,
)
from sparkjourney.operators.stats import describe, histogram, correlation, box_stats
from sparkjourney.plans import tables as t
from sparkjourney.plans.registry import query, round_doubles
from sparkjourney.session import materialize

# Churn thresholds of the registered queries.  Order recency spans years
# (median about half a year), event recency spans days (30 days of events).
ORDERS_CHURN_DAYS = 180
EVENTS_CHURN_DAYS = 1

SQL_RFM_ORDERS = """
  SELECT o_custkey AS user_id,
         CAST(floor(date_diff('microsecond', MAX(o_orderdate), (SELECT MAX(o_orderdate) FROM orders)) / 86400e6) AS BIGINT) AS recency,
         COUNT(DISTINCT o_orderkey) AS frequency,
         COALESCE(SUM(o_totalprice), 0.0) AS monetary
  FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey"""

SQL_RFM_EVENTS = f"""
  SELECT user_id,
         CAST(floor(date_diff('microsecond', MAX(ts), (SELECT MAX(ts) FROM events)) / 86400e6) AS BIGINT) AS recency,
         COUNT(DISTINCT session_id) AS frequency,
         COALESCE(SUM(amount), 0.0) AS monetary
  FROM ({t.SQL_SESSIONS}) GROUP BY user_id"""

SQL_USER_FEATURES = f"""
  WITH s AS ({t.SQL_SESSIONS}),
  ref AS (SELECT MAX(ts) AS r FROM events),
  ps AS (SELECT user_id, session_id, MAX(session_duration) AS d FROM s GROUP BY 1, 2),
  pu AS (SELECT user_id, COUNT(DISTINCT session_id) AS frequency, COALESCE(SUM(amount), 0.0) AS monetary,
                COUNT(*) AS event_count, COUNT(DISTINCT product_id) AS product_count, MAX(ts) AS last_ts,
                MAX(CASE WHEN event_type = 'purchase' THEN ts END) AS last_buy
         FROM s GROUP BY user_id)
  SELECT pu.user_id, frequency, monetary, (SELECT AVG(d) FROM ps WHERE ps.user_id = pu.user_id) AS session_duration,
         event_count, product_count,
         CAST(floor(date_diff('microsecond', last_buy, (SELECT r FROM ref)) / 86400e6) AS BIGINT) AS days_since_last_purchase,
         CAST(floor(date_diff('microsecond', last_ts, (SELECT r FROM ref)) / 86400e6) AS BIGINT) AS recency
  FROM pu"""

SQL_CHURN_FEATURES = f"""
  SELECT *, CAST(CASE WHEN recency >= {EVENTS_CHURN_DAYS} THEN 1 ELSE 0 END AS INTEGER) AS churn
  FROM ({SQL_USER_FEATURES})"""


def orders_rfm(spark, d):
    return rfm(t.orders(spark, d))


def events_rfm(spark, d):
    # reference time from the raw event scan (same value, no re-derivation)
    return rfm_of_events(t.events(spark, d), as_of=reference_time(t.events(spark, d)))


def event_features_of_users(spark, d):
    return features_of_events(t.events(spark, d), as_of=reference_time(t.events(spark, d)))


def churn_features(spark, d):
    """Per-user model features of the events, labelled."""
    return churn_label(event_features_of_users(spark, d), days=EVENTS_CHURN_DAYS)


def churn_labels(spark, d):
    """(user, recency, churn): what the label alone needs."""
    ev = t.events(spark, d)
    return churn_label(recency(ev, as_of=reference_time(ev)), days=EVENTS_CHURN_DAYS)


@query("rfm_orders", f"SELECT user_id, recency, frequency, round(monetary, 6) AS monetary FROM ({SQL_RFM_ORDERS})")
def q_rfm_orders(spark, d):
    return round_doubles(orders_rfm(spark, d))


@query("rfm_events", f"SELECT user_id, recency, frequency, round(monetary, 6) AS monetary FROM ({SQL_RFM_EVENTS})")
def q_rfm_events(spark, d):
    return round_doubles(events_rfm(spark, d))


@query("events_with_rfm", f"""
  SELECT s.event_id, s.user_id, s.session_id, r.recency, r.frequency, round(r.monetary, 6) AS monetary
  FROM ({t.SQL_SESSIONS}) s LEFT JOIN ({SQL_RFM_EVENTS}) r ON r.user_id = s.user_id""")
def q_events_with_rfm(spark, d):
    """The event table with its users' RFM attached."""
    ev = t.events(spark, d)
    s = rfm(t.sessions(spark, d), as_of=reference_time(ev), grain="event")
    return round_doubles(s.select("event_id", "user_id", "session_id", "recency", "frequency", "monetary"))


@query("recency_describe", f"""
  SELECT COUNT(recency) AS count, round(AVG(recency), 6) AS mean, round(stddev_samp(recency), 6) AS std,
         CAST(MIN(recency) AS DOUBLE) AS min,
         round(quantile_cont(recency, 0.5), 6) AS p50, round(quantile_cont(recency, 0.75), 6) AS p75,
         round(quantile_cont(recency, 0.9), 6) AS p90, round(quantile_cont(recency, 0.95), 6) AS p95,
         round(quantile_cont(recency, 0.99), 6) AS p99, CAST(MAX(recency) AS DOUBLE) AS max
  FROM ({SQL_RFM_ORDERS})""")
def q_recency_describe(spark, d):
    return round_doubles(describe(materialize(orders_rfm(spark, d)), "recency"))


@query("recency_histogram", f"""
  WITH r AS ({SQL_RFM_ORDERS}),
  b AS (SELECT CAST(MIN(recency) AS DOUBLE) AS lo, CAST(MAX(recency) AS DOUBLE) AS hi FROM r),
  c AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((CAST(recency AS DOUBLE) - lo) * 30.0 / (hi - lo)), 29) ELSE 0 END AS INTEGER) AS bin,
               COUNT(*) AS n FROM r, b WHERE recency IS NOT NULL GROUP BY 1)
  SELECT g.bin, round(lo + g.bin * ((hi - lo) / 30.0), 6) AS bin_start, round(lo + (g.bin + 1) * ((hi - lo) / 30.0), 6) AS bin_end,
         CAST(COALESCE(c.n, 0) AS BIGINT) AS n
  FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 30)) g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin""")
def q_recency_histogram(spark, d):
    return round_doubles(histogram(materialize(orders_rfm(spark, d)), "recency", bins=30))


@query("churn_counts", f"""
  SELECT CAST(CASE WHEN recency >= {ORDERS_CHURN_DAYS} THEN 1 ELSE 0 END AS INTEGER) AS churn, COUNT(*) AS n_users
  FROM ({SQL_RFM_ORDERS}) GROUP BY 1""")
def q_churn_counts(spark, d):
    return churn_counts(churn_label(orders_rfm(spark, d), days=ORDERS_CHURN_DAYS))


_FEATS = ["frequency", "monetary", "session_duration", "event_count", "product_count"]


@query("user_features", f"""
  SELECT user_id, frequency, round(monetary, 6) AS monetary, round(session_duration, 6) AS session_duration,
         event_count, product_count, days_since_last_purchase, recency
  FROM ({SQL_USER_FEATURES})""")
def q_user_features(spark, d):
    return round_doubles(event_features_of_users(spark, d))


@query("feature_correlation", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS row_feature, '{b}' AS col_feature, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM ({SQL_CHURN_FEATURES})"
    for a in _FEATS + ["churn"] for b in _FEATS + ["churn"]))
def q_feature_correlation(spark, d):
    return round_doubles(correlation(churn_features(spark, d), _FEATS + ["churn"]))


@query("box_by_churn", f"""
  WITH f AS ({SQL_CHURN_FEATURES}),
  l AS ({" UNION ALL ".join(f"SELECT churn AS label, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM f" for c in _FEATS)}),
  q AS (SELECT label, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
        FROM l WHERE x IS NOT NULL GROUP BY 1, 2)
  SELECT l.label, l.feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
         round(MIN(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END), 6) AS lower_whisker,
         round(MAX(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END), 6) AS upper_whisker,
         COUNT(*) FILTER (WHERE NOT (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS n_outliers
  FROM l JOIN q ON l.label = q.label AND l.feature = q.feature
  WHERE x IS NOT NULL
  GROUP BY l.label, l.feature, q1, median, q3""")
def q_box_by_churn(spark, d):
    return round_doubles(box_stats(materialize(churn_features(spark, d)), "churn", _FEATS))
