"""Churn model queries: split, class weights, naive Bayes, metrics (SQL-checked),
and the Spark ML model comparison / grid search / importances (rows-checked)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkjourney.operators.churn import (
    FEATURES, stratified_split, stratified_split_exact, class_weights, gaussian_nb, train_churn, tune_forest, feature_importance,
    network_loss_history,
)
from sparkjourney.operators.metrics import confusion, class_report, predict_at, roc_points, roc_auc
from sparkjourney.plans.profiles import churn_features, churn_labels, SQL_CHURN_FEATURES
from sparkjourney.plans.registry import query, round_doubles
from sparkjourney.session import materialize

SQL_SPLIT = f"""
  SELECT *, CASE WHEN CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 20
                 THEN 'test' ELSE 'train' END AS split
  FROM ({SQL_CHURN_FEATURES})"""

_F = list(FEATURES)
_PARAMS = ", ".join(
    [f"var_pop(CAST({f} AS DOUBLE)) AS v_{f}" for f in _F]
    + [f"avg(CASE WHEN churn = {c} THEN CAST({f} AS DOUBLE) END) AS m{c}_{f}" for f in _F for c in (0, 1)]
    + [f"var_pop(CASE WHEN churn = {c} THEN CAST({f} AS DOUBLE) END) AS v{c}_{f}" for f in _F for c in (0, 1)])


def _jll(c):
    nc = "n1" if c == 1 else "(n - n1)"
    terms = [f"ln({nc} / n)"]
    for f in _F:
        var = f"(v{c}_{f} + eps)"
        terms.append(f"- 0.5 * ln({2.0 * math.pi!r} * {var}) - (CAST({f} AS DOUBLE) - m{c}_{f}) * (CAST({f} AS DOUBLE) - m{c}_{f}) / (2.0 * {var})")
    return " ".join(terms)


SQL_NB = f"""
  WITH d AS ({SQL_SPLIT}),
  p0 AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE churn = 1) AS n1, {_PARAMS} FROM d WHERE split = 'train'),
  p AS (SELECT *, 1e-9 * greatest({", ".join(f"v_{f}" for f in _F)}) AS eps FROM p0),
  j AS (SELECT d.user_id, d.churn, {_jll(0)} AS j0, {_jll(1)} AS j1 FROM d, p WHERE d.split = 'test')
  SELECT user_id, churn, round(1.0 / (1.0 + exp(j0 - j1)), 6) AS probability, CAST(j1 > j0 AS INTEGER) AS prediction
  FROM j"""


def nb_scored(spark, d):
    # user-grain table, checkpointed: the fit, the scoring and the metrics all
    # read it without recomputing the sessions underneath
    data = materialize(stratified_split(churn_features(spark, d)))
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    out = gaussian_nb(train, test, FEATURES, "churn")
    return round_doubles(out.select("user_id", "churn", "probability", "prediction"))


@query("stratified_split", f"SELECT user_id, churn, split FROM ({SQL_SPLIT})")
def q_stratified_split(spark, d):
    return stratified_split(churn_labels(spark, d)).select("user_id", "churn", "split")


@query("stratified_split_exact", f"""
  WITH f AS (SELECT user_id, churn, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM ({SQL_CHURN_FEATURES})),
  r AS (SELECT *, rank() OVER (PARTITION BY churn ORDER BY h) AS r, COUNT(*) OVER (PARTITION BY churn) AS n FROM f)
  SELECT user_id, churn, CASE WHEN r <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r""")
def q_stratified_split_exact(spark, d):
    return stratified_split_exact(materialize(churn_labels(spark, d))).select("user_id", "churn", "split")


@query("class_weights", f"""
  WITH t AS (SELECT churn, COUNT(*) AS n FROM ({SQL_SPLIT}) WHERE split = 'train' GROUP BY churn)
  SELECT churn, n, round((SELECT SUM(n) FROM t) / ((SELECT COUNT(*) FROM t) * n), 6) AS weight FROM t""")
def q_class_weights(spark, d):
    tr = stratified_split(churn_labels(spark, d)).where(F.col("split") == "train")
    return round_doubles(class_weights(tr, "churn"))


@query("gaussian_nb", SQL_NB)
def q_gaussian_nb(spark, d):
    return nb_scored(spark, d)


@query("confusion", f"""
  WITH s AS ({SQL_NB}), g AS (SELECT * FROM (VALUES (0), (1)) a(churn), (VALUES (0), (1)) b(prediction))
  SELECT g.churn, g.prediction, COUNT(s.user_id) AS n
  FROM g LEFT JOIN s ON g.churn = s.churn AND g.prediction = s.prediction GROUP BY 1, 2""")
def q_confusion(spark, d):
    return confusion(nb_scored(spark, d), "churn", "prediction")


THRESHOLDS = (0.3, 0.5, 0.7)


@query("threshold_predictions", f"""
  WITH s AS ({SQL_NB})
  SELECT user_id, churn, probability, {", ".join(f"CAST(probability >= {x} AS INTEGER) AS at_{round(100 * x)}" for x in THRESHOLDS)} FROM s""")
def q_threshold_predictions(spark, d):
    out = nb_scored(spark, d).drop("prediction")
    for x in THRESHOLDS:
        out = predict_at(out, threshold=x, name=f"at_{round(100 * x)}")
    return out


def _sdiv(a, b):
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


def _sf1(p, r):
    return f"CASE WHEN ({p}) + ({r}) > 0 THEN 2.0 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"


SQL_REPORT = f"""
  WITH s AS ({SQL_NB}),
  c AS (SELECT {", ".join(f"COUNT(*) FILTER (WHERE churn = {a} AND prediction = {p}) AS c{a}{p}" for a in (0, 1) for p in (0, 1))} FROM s),
  m AS (SELECT *, c00 + c01 AS n0, c10 + c11 AS n1,
               {_sdiv("c00", "c00 + c10")} AS p0, {_sdiv("c00", "c00 + c01")} AS r0,
               {_sdiv("c11", "c11 + c01")} AS p1, {_sdiv("c11", "c10 + c11")} AS r1 FROM c),
  f AS (SELECT *, {_sf1("p0", "r0")} AS f0, {_sf1("p1", "r1")} AS f1, n0 + n1 AS tot FROM m)
  SELECT '0' AS "row", round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, n0 AS support FROM f
  UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), n1 FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, round({_sdiv("c00 + c11", "tot")}, 6), tot FROM f
  UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), tot FROM f
  UNION ALL SELECT 'weighted avg', round({_sdiv("p0 * n0 + p1 * n1", "tot")}, 6), round({_sdiv("r0 * n0 + r1 * n1", "tot")}, 6),
                   round({_sdiv("f0 * n0 + f1 * n1", "tot")}, 6), tot FROM f"""


@query("class_report", SQL_REPORT)
def q_class_report(spark, d):
    return round_doubles(class_report(nb_scored(spark, d), "churn", "prediction"))


@query("roc_points", f"""
  WITH s AS ({SQL_NB}),
  sc AS (SELECT probability AS score, COUNT(*) FILTER (WHERE churn = 1) AS pos, COUNT(*) FILTER (WHERE churn = 0) AS neg
         FROM s GROUP BY 1),
  c AS (SELECT score, SUM(pos) OVER (ORDER BY score DESC) AS tp, SUM(neg) OVER (ORDER BY score DESC) AS fp FROM sc),
  t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM sc)
  SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
  UNION ALL
  SELECT score, round({_sdiv("fp", "N")}, 6), round({_sdiv("tp", "P")}, 6) FROM c, t""")
def q_roc_points(spark, d):
    return round_doubles(roc_points(nb_scored(spark, d), "churn", "probability"))


@query("roc_auc", f"""
  WITH s AS ({SQL_NB}),
  sc AS (SELECT probability AS score, COUNT(*) FILTER (WHERE churn = 1) AS pos, COUNT(*) FILTER (WHERE churn = 0) AS neg
         FROM s GROUP BY 1),
  c AS (SELECT *, SUM(neg) OVER (ORDER BY score) - neg AS below FROM sc)
  SELECT round({_sdiv("SUM(pos * (below + 0.5 * neg))", "(SELECT SUM(pos) * SUM(neg) FROM sc)")}, 6) AS auc FROM c""")
def q_roc_auc(spark, d):
    return round_doubles(roc_auc(nb_scored(spark, d), "churn", "probability"))


@query("churn_models")
def q_churn_models(spark, d):
    rows, _ = train_churn(churn_features(spark, d))
    return spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, "
                                       "f1 double, roc_auc double")


@query("feature_importance")
def q_feature_importance(spark, d):
    _, fitted = train_churn(churn_features(spark, d), models=["Random Forest"])
    return spark.createDataFrame(feature_importance(fitted["Random Forest"]), "feature string, importance double")


@query("churn_grid")
def q_churn_grid(spark, d):
    params, m, _ = tune_forest(churn_features(spark, d))
    return spark.createDataFrame(
        [(params["numTrees"], params["maxDepth"], params["minInstancesPerNode"], params["featureSubsetStrategy"],
          *[float(v) for v in m])],
        "num_trees int, max_depth int, min_instances_per_node int, feature_subset string, accuracy double, "
        "precision double, recall double, f1 double, roc_auc double")


@query("nn_loss_history")
def q_nn_loss_history(spark, d):
    return spark.createDataFrame(network_loss_history(churn_features(spark, d)), "iteration int, loss double")
