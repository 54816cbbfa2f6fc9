"""Recommendation and intent queries on the driver's events (purchase / view)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkjourney.operators.intent import high_intent
from sparkjourney.operators.recommend import (
    purchase_counts, default_seed, user_neighbours, collab_scores, cooccurrence_scores, hybrid_scores,
    svd_neighbours,
)
from sparkjourney.plans import tables as t
from sparkjourney.plans.registry import query, round_doubles
from sparkjourney.session import materialize

SQL_COUNTS = f"""
  SELECT user_id, product_id, COUNT(*) AS n FROM ({t.SQL_EVENTS})
  WHERE event_type = 'purchase' AND user_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2"""
SQL_WITH = f"""
  c AS ({SQL_COUNTS}),
  s AS (SELECT MIN(user_id) AS seed FROM c),
  mine AS (SELECT product_id, n AS n_seed FROM c WHERE user_id = (SELECT seed FROM s))"""
SQL_SIM = f"""
  WITH {SQL_WITH},
  norms AS (SELECT user_id, sqrt(SUM(n * n)) AS norm FROM c GROUP BY user_id),
  dots AS (SELECT c.user_id, SUM(c.n * m.n_seed) AS dot FROM c JOIN mine m ON c.product_id = m.product_id GROUP BY c.user_id),
  sim AS (SELECT norms.user_id AS neighbour,
                 COALESCE(dot, 0) / (norm * (SELECT sqrt(SUM(n_seed * n_seed)) FROM mine)) AS similarity
          FROM norms LEFT JOIN dots ON norms.user_id = dots.user_id WHERE norms.user_id <> (SELECT seed FROM s))
  SELECT (SELECT seed FROM s) AS seed_user, neighbour, similarity,
         CAST(row_number() OVER (ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank
  FROM sim ORDER BY similarity DESC, neighbour LIMIT 5"""
SQL_COLLAB = f"""
  WITH {SQL_WITH}, nb AS (SELECT neighbour FROM ({SQL_SIM}))
  SELECT c.product_id, CAST(SUM(c.n) AS BIGINT) AS collab_score FROM c JOIN nb ON c.user_id = nb.neighbour
  WHERE c.product_id NOT IN (SELECT product_id FROM mine) GROUP BY 1 HAVING SUM(c.n) > 0"""
# the analysis' own formulation: count every pair of distinct products per user
SQL_COOC = f"""
  WITH {SQL_WITH},
  b AS (SELECT DISTINCT user_id, product_id FROM c),
  pairs AS (SELECT x.product_id AS a, y.product_id AS b, COUNT(*) AS n
            FROM b x JOIN b y ON x.user_id = y.user_id AND x.product_id <> y.product_id GROUP BY 1, 2)
  SELECT b AS product_id, CAST(SUM(n) AS BIGINT) AS cooccur_score FROM pairs
  WHERE a IN (SELECT product_id FROM mine) AND b NOT IN (SELECT product_id FROM mine) GROUP BY 1"""


def counts(spark, d):
    # (user, product) counts feed every branch (seed, norms, dots, neighbours,
    # scores): checkpointed once, far smaller than the events
    return materialize(purchase_counts(t.events(spark, d)))


@query("user_neighbours", f"SELECT seed_user, neighbour, round(similarity, 6) AS similarity, rank FROM ({SQL_SIM})")
def q_user_neighbours(spark, d):
    nb = user_neighbours(counts(spark, d), k=5)
    return round_doubles(nb.withColumn("rank", F.col("rank").cast("int")))


@query("collab_scores", SQL_COLLAB)
def q_collab_scores(spark, d):
    c = counts(spark, d)
    return collab_scores(c, user_neighbours(c, k=5))


@query("cooccur_scores", SQL_COOC)
def q_cooccur_scores(spark, d):
    return cooccurrence_scores(counts(spark, d))


@query("hybrid_top10", f"""
  WITH cs AS ({SQL_COLLAB}), co AS ({SQL_COOC}),
  j AS (SELECT COALESCE(cs.product_id, co.product_id) AS product_id,
               CAST(COALESCE(collab_score, 0) AS DOUBLE) AS collab_score,
               CAST(COALESCE(cooccur_score, 0) AS DOUBLE) AS cooccur_score
        FROM cs FULL OUTER JOIN co ON cs.product_id = co.product_id)
  SELECT product_id, collab_score, cooccur_score, collab_score + cooccur_score AS hybrid_score
  FROM j ORDER BY hybrid_score DESC, product_id LIMIT 10""")
def q_hybrid_top10(spark, d):
    c = counts(spark, d)
    seed = default_seed(c)
    nb = user_neighbours(c, seed, k=5)
    return hybrid_scores(collab_scores(c, nb, seed), cooccurrence_scores(c, seed), n=10)


@query("high_intent", f"""
  WITH v AS (SELECT user_id, product_id, COUNT(*) AS view_count FROM ({t.SQL_EVENTS})
             WHERE event_type = 'view' AND user_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY view_count DESC, product_id) AS rn FROM v)
  SELECT user_id, product_id, view_count FROM b WHERE rn = 1 ORDER BY view_count DESC, user_id LIMIT 10""")
def q_high_intent(spark, d):
    return high_intent(t.events(spark, d), "view", n=10)


@query("svd_neighbours")
def q_svd_neighbours(spark, d):
    return svd_neighbours(counts(spark, d), k=5, factors=20)
