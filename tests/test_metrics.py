import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkjourney.operators.metrics import running_totals, roc_auc, roc_points, confusion, class_report


def _auc_brute(y, s):
    pos = [a for a, l in zip(s, y) if l == 1]
    neg = [a for a, l in zip(s, y) if l == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_running_totals_exact_with_many_buckets(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.permutation(500).astype(float), "v": rng.integers(0, 9, 500)})
    got = running_totals(spark.createDataFrame(pdf), "k", ["v"], buckets=16).toPandas().sort_values("k")
    assert (got["v_cum"].to_numpy() == pdf.sort_values("k")["v"].cumsum().to_numpy()).all()


def test_auc_ties_and_monotone_invariance(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) + 0.3 * y, 1)  # many ties
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    a = roc_auc(df).first().auc
    assert abs(a - _auc_brute(y, s)) < 1e-12
    b = roc_auc(df.withColumn("score", F.exp(F.col("score") * 3))).first().auc
    assert abs(a - b) < 1e-12
    tie = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert roc_auc(tie).first().auc == 0.5


def test_roc_points_end_at_one(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    pts = sorted((r.fpr, r.tpr) for r in roc_points(df).collect())
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0) and len(pts) == 5


def test_confusion_grid_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, prediction int")
    cm = {(r.label, r.prediction): r.n for r in confusion(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    rep = {r.row: r for r in class_report(df).collect()}
    assert rep["1"].precision == 0.5 and rep["1"].recall == 0.5 and rep["1"].support == 2
    assert rep["accuracy"].f1 == 0.6 and rep["accuracy"].precision is None
    only_neg = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    assert class_report(only_neg).where("row = '1'").first().precision == 0.0
