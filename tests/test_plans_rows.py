"""Rows-checked queries (model fits, randomized algorithms): properties on the smoke tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMOKE

Q = E.queries()


def run(spark, name):
    return Q[name](spark, SMOKE)


def test_pca_variance(spark):
    r = run(spark, "pca_variance").orderBy("component").collect()
    assert [x.component for x in r] == [1, 2, 3]
    assert abs(r[-1].cumulative - 1.0) < 1e-9
    assert r[0].explained >= r[1].explained >= r[2].explained


def test_kmeans_sweep_and_segments(spark):
    rows = run(spark, "kmeans_sweep").collect()
    assert sorted(x.k for x in rows) == list(range(2, 11))
    assert sum(x.chosen for x in rows) == 1
    seg = run(spark, "segments")
    n_users = spark.read.parquet(f"{SMOKE}/events.parquet").select("user_id").distinct().count()
    assert seg.count() == n_users == seg.select("user_id").distinct().count()


def test_svd_neighbours(spark):
    r = run(spark, "svd_neighbours").orderBy("rank").collect()
    assert [x.rank for x in r] == [1, 2, 3, 4, 5]
    assert all(x.neighbour != x.seed_user for x in r)
    assert all(-1.0 - 1e-9 <= x.similarity <= 1.0 + 1e-9 for x in r)
    assert [x.similarity for x in r] == sorted((x.similarity for x in r), reverse=True)


def test_rfm_anomalies_and_marts(spark):
    a = run(spark, "rfm_anomalies")
    n = a.count()
    assert a.select("user_id").distinct().count() == n
    assert {x.anomaly for x in a.select("anomaly").distinct().collect()} <= {-1, 1}
    assert a.where((F.col("anomaly_score") <= 0) | (F.col("anomaly_score") >= 1)).count() == 0
    ps = run(spark, "project_summary")
    assert ps.count() == ps.select("user_id").distinct().count()
    sh = run(spark, "snapshot_shares").groupBy("dimension").agg(F.sum("share").alias("s")).collect()
    assert {x.dimension for x in sh} == {"cluster", "churn", "rfm_anomaly", "event_anomaly"}
    assert all(abs(x.s - 1.0) < 1e-5 for x in sh)
    tot = run(spark, "summary_totals").first()
    assert tot.total_users == ps.count()
    ac = {x.kind: x.users for x in run(spark, "anomaly_counts").collect()}
    assert ac["Event Spikes"] == run(spark, "event_spikes").count()
    assert tot.event_anomalies == ac["Event Spikes"]


def test_churn_models_importance_loss(spark):
    m = run(spark, "churn_models").collect()
    assert len(m) == 5
    for x in m:
        for v in (x.accuracy, x.precision, x.recall, x.f1, x.roc_auc):
            assert v is None or 0.0 <= v <= 1.0
    imp = run(spark, "feature_importance").collect()
    assert abs(sum(x.importance for x in imp) - 1.0) < 1e-6
    loss = run(spark, "nn_loss_history").orderBy("iteration").collect()
    assert len(loss) > 1 and loss[-1].loss < loss[0].loss


def test_forest_grid_search_small(spark):
    import numpy as np
    import pandas as pd
    from sparkjourney.operators.churn import tune_forest, FEATURES
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    pdf = pd.DataFrame(rng.normal(0, 1, (300, 5)) + 2.5 * y[:, None], columns=list(FEATURES))
    pdf["user_id"] = np.arange(300, dtype="int64")
    pdf["churn"] = y.astype("int32")
    params, metrics, _ = tune_forest(spark.createDataFrame(pdf), grid_kwargs=dict(
        trees=(10, 20), depths=(5,), min_instances=(1,), subsets=("sqrt",)))
    assert params["numTrees"] in (10, 20) and params["maxDepth"] == 5
    assert metrics.roc_auc > 0.9
