"""One event shuffle for per-user session totals; no cut in the models; sampling alike at every size."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMOKE
from sparkjourney.operators.anomaly import isolation_forest
from sparkjourney.operators.churn import balance_by_replication, model_zoo, FEATURES
from sparkjourney.operators.rfm import features_of_events, rfm, rfm_of_events, user_features
from sparkjourney.operators.sessions import sessionize

Q = E.queries()
EVENT = "event_id long, user_id long, ts timestamp_ntz, event_type string, product_id int, amount double"


def _plan(spark, name):
    """Executed plan with broadcast joins off, the shape at scale."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return Q[name](spark, SMOKE)._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["rfm_events", "user_features", "feature_correlation"])
def test_events_are_shuffled_once(spark, name):
    assert _plan(spark, name).count("_bucket#") and sum(
        "hashpartitioning(user_id" in x and "_bucket" in x for x in _plan(spark, name).splitlines()) == 1


@pytest.mark.parametrize("name", ["stratified_split", "class_weights"])
def test_labels_need_no_sessions(spark, name):
    assert "Window" not in _plan(spark, name) and "_bucket" not in _plan(spark, name)


def _events(spark, n, seed):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 1 / 3
    # a third of all events: one user within one hour
    sec = np.where(hot, rng.integers(0, 3600, n), rng.integers(0, 5 * 86400, n))
    rows = [(i, None if i % 97 == 0 else int(0 if hot[i] else rng.integers(1, 30)),
             None if i % 89 == 0 else (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=int(sec[i]))).to_pydatetime(),
             "purchase" if i % 7 == 0 else "view", None if i % 5 == 0 else int(i % 11), None if i % 3 == 0 else float(i % 13))
            for i in range(n)]
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize("n", [0, 1, 2500])
def test_totals_equal_the_sessionized_form(spark, n):
    ev = _events(spark, n, 5)
    s = sessionize(ev)
    ref = ev.select(F.max("ts")).scalar()
    for got, want in ((rfm_of_events(ev, as_of=ref), rfm(s, as_of=ref)), (features_of_events(ev, as_of=ref), user_features(s, as_of=ref))):
        a, b = (x.select(*want.columns).orderBy("user_id").toPandas() for x in (got, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_models_are_uncut():
    zoo = model_zoo(FEATURES)
    forest, boosted = zoo["Random Forest"][0].getStages()[-1], zoo["Gradient Boosted Trees"][0].getStages()[-1]
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, 30)
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (100, 6, 0.3)


def test_replication_follows_a_broken_ratio(spark):
    df = spark.range(9900).select(F.col("id").alias("user_id"), (F.col("id") < 4000).cast("int").alias("churn"))
    n = {r["churn"]: r["count"] for r in balance_by_replication(df).groupBy("churn").count().collect()}
    assert n[0] == 5900 and abs(n[1] - 5900) < 200


@pytest.mark.parametrize("n", [1000, 60_000])
def test_flagged_share_is_the_contamination(spark, n):
    df = spark.range(n).select(F.col("id").alias("user_id"), (F.rand(3) + 0).alias("a"), F.rand(4).alias("b"))
    flagged = isolation_forest(df, ["a", "b"], trees=20, sample=64, contamination=0.02, seed=1).where("anomaly = -1").count()
    assert abs(flagged - 0.02 * n) <= max(2, 0.002 * n)


@pytest.mark.parametrize("r", [0.004, 0.3])
def test_first_tree_rule_gives_independent_trees(r):
    """The rule of the forest's sampling: marginals r, joint r^2."""
    rng, trees, n = np.random.default_rng(1), 10, 400_000
    first = np.floor(np.log1p(-rng.random(n)) / math.log1p(-r))
    t = np.arange(trees)
    member = (t == first[:, None]) | ((t > first[:, None]) & (rng.random((n, trees)) < r))
    assert np.allclose(member.mean(axis=0), r, atol=5 * math.sqrt(r / n))
    joint = (member.T.astype(float) @ member.astype(float)) / n
    off = joint[~np.eye(trees, dtype=bool)]
    assert np.allclose(off, r * r, atol=6 * math.sqrt(max(r * r, 1 / n) / n))
