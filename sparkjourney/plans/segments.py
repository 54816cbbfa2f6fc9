"""Segment queries: fixed-centre assignment, profiles, actions, PCA and K-means steps
from fixed starts (SQL-checked), and the K-means segmentation (rows-checked)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparkjourney import schema as S
from sparkjourney.operators.segments import (
    RFM_COLS, MARKETING_ACTIONS, nearest_centroid, cluster_profile, marketing_actions, action_counts,
    choose_k, scaled_features, pca_variance, segment,
)
from sparkjourney.operators.kmeans import kmeans_sweep, lloyd, silhouettes
from sparkjourney.operators.stats import standardize
from sparkjourney.plans.profiles import events_rfm, SQL_RFM_EVENTS
from sparkjourney.plans.registry import query, round_doubles
from sparkjourney.session import materialize

# Centres in standardized (recency, frequency, monetary) space for the
# SQL-checked assignment: 0 recent/frequent/high spend, 1 average,
# 2 lapsed/infrequent/low spend.
SEGMENT_CENTRES = [(-0.5, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, -1.0, -1.0)]


def fixed_segments(spark, d, prof=None):
    """Events RFM -> z-scores -> nearest fixed centre: (user, recency, frequency, monetary, cluster, distance)."""
    # user-grain RFM, checkpointed: the scaler fit and the assignment read it once each
    z = standardize(prof or materialize(events_rfm(spark, d)), list(RFM_COLS), fit="row")
    seg = nearest_centroid(z, [c + "_z" for c in RFM_COLS], SEGMENT_CENTRES)
    return seg.select(S.USER, *RFM_COLS, "cluster", "distance")


def _sql_dist(k, c):
    return " + ".join(f"({col}_z - ({v}))*({col}_z - ({v}))" for col, v in zip(RFM_COLS, c))


SQL_FIXED_SEGMENTS = f"""
  WITH r AS ({SQL_RFM_EVENTS}),
  z AS (SELECT *, {", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END AS {c}_z" for c in RFM_COLS)} FROM r),
  dd AS (SELECT *, {", ".join(f"{_sql_dist(k, c)} AS d{k}" for k, c in enumerate(SEGMENT_CENTRES))} FROM z)
  SELECT user_id, recency, frequency, monetary,
         CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster,
         sqrt(least(d0, d1, d2)) AS distance
  FROM dd"""

SQL_ACTIONS = f"""
  SELECT user_id, recency, frequency, monetary, cluster,
         CASE cluster {" ".join(f"WHEN {k} THEN '{v}'" for k, v in MARKETING_ACTIONS.items())} END AS marketing_action
  FROM ({SQL_FIXED_SEGMENTS})"""


@query("nearest_centroid", f"""
  SELECT user_id, recency, frequency, round(monetary, 6) AS monetary, cluster, round(distance, 6) AS distance
  FROM ({SQL_FIXED_SEGMENTS})""")
def q_nearest_centroid(spark, d):
    return round_doubles(fixed_segments(spark, d))


@query("cluster_profile", f"""
  SELECT cluster, COUNT(*) AS n_users, round(AVG(recency), 6) AS avg_recency,
         round(AVG(frequency), 6) AS avg_frequency, round(AVG(monetary), 6) AS avg_monetary
  FROM ({SQL_FIXED_SEGMENTS}) GROUP BY cluster""")
def q_cluster_profile(spark, d):
    # means of cent amounts can sit exactly on a 2-place rounding tie, where
    # summation order decides the side; report at the common 6-place precision
    return round_doubles(cluster_profile(fixed_segments(spark, d), places=None))


@query("marketing_actions", f"SELECT user_id, recency, frequency, round(monetary, 6) AS monetary, cluster, marketing_action FROM ({SQL_ACTIONS})")
def q_marketing_actions(spark, d):
    return round_doubles(marketing_actions(fixed_segments(spark, d)))


@query("action_counts", f"""
  SELECT marketing_action, COUNT(*) AS customer_count FROM ({SQL_ACTIONS})
  WHERE marketing_action IS NOT NULL GROUP BY marketing_action""")
def q_action_counts(spark, d):
    return action_counts(marketing_actions(fixed_segments(spark, d)))


_PAIRS = (("recency", "frequency"), ("recency", "monetary"), ("frequency", "monetary"))


def _sql_pca():
    """Eigenvalues of the 3 x 3 covariance of the z-scores in closed form (trigonometric
    solution of the characteristic equation); no component is left out, so their sum is the trace."""
    own = ", ".join(f"CASE WHEN stddev_pop({c}) > 0 THEN 1.0 ELSE 0.0 END AS d{i}" for i, c in enumerate(RFM_COLS))
    off = ", ".join(f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / stddev_pop({a}) / stddev_pop({b}) ELSE 0.0 END AS {n}"
                    for (a, b), n in zip(_PAIRS, "xyz"))
    return f"""
  WITH m AS (SELECT {own}, {off} FROM ({SQL_RFM_EVENTS})),
  q AS (SELECT *, (d0 + d1 + d2) / 3 AS q, x * x + y * y + z * z AS p1 FROM m),
  p AS (SELECT *, sqrt(((d0 - q) * (d0 - q) + (d1 - q) * (d1 - q) + (d2 - q) * (d2 - q) + 2 * p1) / 6) AS p FROM q),
  r AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE greatest(-1, least(1, (
          (d0 - q) * ((d1 - q) * (d2 - q) - z * z) - x * (x * (d2 - q) - z * y) + y * (x * z - (d1 - q) * y)) / (2 * p * p * p))) END AS r FROM p),
  e AS (SELECT *, q + 2 * p * cos(acos(r) / 3) AS e1, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS e3 FROM r),
  v AS (SELECT e1 / (3 * q) AS v1, (3 * q - e1 - e3) / (3 * q) AS v2, e3 / (3 * q) AS v3 FROM e)
  SELECT 1 AS component, round(v1, 6) AS explained, round(v1, 6) AS cumulative FROM v
  UNION ALL SELECT 2, round(v2, 6), round(v1 + v2, 6) FROM v
  UNION ALL SELECT 3, round(v3, 6), round(v1 + v2 + v3, 6) FROM v"""


@query("pca_variance", _sql_pca())
def q_pca_variance(spark, d):
    pca, _, _ = scaled_features(events_rfm(spark, d), RFM_COLS, pca_k=3)
    return round_doubles(spark.createDataFrame(pca_variance(pca), "component int, explained double, cumulative double"))


# Fixed starts and steps of the SQL-checked K-means: the first k of these, moved FIXED_STEPS times.
FIXED_STARTS = [*SEGMENT_CENTRES, (0.5, 0.5, -0.5)]
FIXED_KS = (2, 3, 4)
FIXED_STEPS = 3
_AXES = tuple("abc")


def _sql_kmeans(k):
    """CTEs p (points), c0..cN (centres after each step) and a (final assignment), for one k."""
    points = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END AS {x}" for c, x in zip(RFM_COLS, _AXES))
    out = [f"p{k} AS (SELECT user_id, {points} FROM ({SQL_RFM_EVENTS}))",
           f"c{k}_0 AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x[0]:.1f}::DOUBLE, {x[1]:.1f}::DOUBLE, {x[2]:.1f}::DOUBLE)' for i, x in enumerate(FIXED_STARTS[:k]))}) t(cluster, a, b, c))"]
    far = "+".join(f"(p.{x} - c.{x}) * (p.{x} - c.{x})" for x in _AXES)
    for i in range(FIXED_STEPS + 1):
        out.append(f"""a{k}_{i} AS (SELECT user_id, a, b, c, cluster, d2 FROM (SELECT p.*, c.cluster, {far} AS d2,
            row_number() OVER (PARTITION BY p.user_id ORDER BY {far}, c.cluster) AS r FROM p{k} p, c{k}_{i} c) t WHERE r = 1)""")
        if i < FIXED_STEPS:
            out.append(f"""c{k}_{i + 1} AS (SELECT c.cluster, {', '.join(f'coalesce(m.{x}, c.{x}) AS {x}' for x in _AXES)} FROM c{k}_{i} c
            LEFT JOIN (SELECT cluster, {', '.join(f'avg({x}) AS {x}' for x in _AXES)} FROM a{k}_{i} GROUP BY cluster) m ON m.cluster = c.cluster)""")
    return ",\n".join(out)


def _sql_silhouette(k):
    """By the definition: mean squared distances between all pairs of points."""
    n = FIXED_STEPS
    far = "+".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in _AXES)
    return f"""m{k} AS (SELECT x.user_id, x.cluster, y.cluster AS other, sum({far}) AS s, count(*) AS n FROM a{k}_{n} x, a{k}_{n} y GROUP BY 1, 2, 3),
  s{k} AS (SELECT user_id, max(CASE WHEN other = cluster THEN n END) AS own, max(CASE WHEN other = cluster THEN s / greatest(n - 1, 1) END) AS a,
             min(CASE WHEN other <> cluster THEN s / n END) AS b FROM m{k} GROUP BY user_id),
  k{k} AS (SELECT {k} AS k, (SELECT round(sum(d2), 6) FROM a{k}_{n}) AS inertia,
             round(avg(CASE WHEN own > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END), 6) AS silhouette FROM s{k})"""


SQL_FIXED_SWEEP = "WITH " + ",\n".join(_sql_kmeans(k) + ",\n" + _sql_silhouette(k) for k in FIXED_KS) + "\n" + " UNION ALL ".join(
    f"SELECT * FROM k{k}" for k in FIXED_KS)


def fixed_models(spark, d):
    """(z-scored RFM, its columns, {(k,): centres}, {(k,): inertia}) after FIXED_STEPS steps of all k together."""
    _, z, cols = scaled_features(events_rfm(spark, d), RFM_COLS, pca_k=None)
    z = materialize(z)
    models, inertia = lloyd(z, cols, {(k,): np.array(FIXED_STARTS[:k]) for k in FIXED_KS}, FIXED_STEPS, 0.0)
    return z, cols, models, inertia


@query("kmeans_steps", f"""
  WITH {_sql_kmeans(3)}
  SELECT c.cluster, round(c.a, 6) AS recency_z, round(c.b, 6) AS frequency_z, round(c.c, 6) AS monetary_z, COUNT(a.user_id) AS n_users
  FROM c3_{FIXED_STEPS} c LEFT JOIN a3_{FIXED_STEPS} a ON a.cluster = c.cluster GROUP BY ALL""")
def q_kmeans_steps(spark, d):
    """K-means from fixed starts: the centres after a fixed number of steps, and their users."""
    z, cols, models, _ = fixed_models(spark, d)
    centres = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(models[(3,)])], ["cluster", *cols])
    sizes = nearest_centroid(z, cols, models[(3,)].tolist()).groupBy("cluster").agg(F.count("*").alias("n_users"))
    out = centres.join(sizes, "cluster", "left").withColumn("n_users", F.coalesce("n_users", F.lit(0).cast("bigint")))
    return round_doubles(out.withColumn("cluster", F.col("cluster").cast("int")))


def fixed_sweep(spark, d):
    z, cols, models, inertia = fixed_models(spark, d)
    sil = silhouettes(z, cols, models)
    return round_doubles(spark.createDataFrame([(k, inertia[(k,)], sil[(k,)]) for k in FIXED_KS], "k int, inertia double, silhouette double"))


@query("kmeans_fixed_sweep", SQL_FIXED_SWEEP)
def q_kmeans_fixed_sweep(spark, d):
    return fixed_sweep(spark, d)


@query("choose_k", f"SELECT * FROM ({SQL_FIXED_SWEEP}) ORDER BY silhouette DESC, k LIMIT 1")
def q_choose_k(spark, d):
    return choose_k(fixed_sweep(spark, d))


@query("kmeans_sweep")
def q_kmeans_sweep(spark, d):
    _, feats, cols = scaled_features(events_rfm(spark, d), RFM_COLS, pca_k=3)
    rows, _ = kmeans_sweep(materialize(feats.select(S.USER, *cols)), cols, S.USER, range(2, 11))
    best = sorted(rows, key=lambda r: (-r[2], r[0]))[0][0]  # best silhouette, smallest k on ties
    return spark.createDataFrame([(*r, r[0] == best) for r in rows],
                                 "k int, inertia double, silhouette double, chosen boolean")


@query("segments")
def q_segments(spark, d):
    seg, _, _ = segment(events_rfm(spark, d))
    return seg
