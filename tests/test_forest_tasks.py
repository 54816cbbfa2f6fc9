"""Forests grown in tasks: one tree against Spark's, depths and bins, figures, and no tree on the driver."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkjourney.operators import churn, forest as fo

FEATURES = list(churn.FEATURES)


def _users(n, seed=3, whole=False):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(0, 1, (n, 5)) + 0.9 * y[:, None]
    pdf = pd.DataFrame(np.clip(np.rint(8 * x + 12), 0, 31) if whole else x, columns=FEATURES)
    pdf["user_id"], pdf["churn"] = np.arange(n, dtype="int64"), y.astype("int32")
    return pdf


def _plain_tree(pdf, forest, tree=0):
    bins = pdf[FEATURES].to_numpy().astype(np.uint8).T.copy()
    counts = np.stack([pdf.churn == 0, pdf.churn == 1], 1).astype(float)
    return bins, counts, fo.grow(bins, counts, forest, tree)


@pytest.mark.parametrize("depth, least", [(30, 1), (4, 1), (30, 12)])
def test_a_tree_is_sparks_tree(spark, depth, least):
    """All columns at each node and no bootstrap: the same shares of classes and importances as Spark's tree."""
    from pyspark.ml.classification import DecisionTreeClassifier
    pdf = _users(700, whole=True)
    bins, _, t = _plain_tree(pdf, fo.Forest(1, depth, least, 5))
    stop = fo.leaves(t, depth)
    ours = fo.votes(t.feature, t.split, np.where(stop, -1, t.left), fo.shares(t), bins) / 2 ** fo.SHIFT
    rows = churn._assembler(FEATURES).transform(churn.binary_label(spark.createDataFrame(pdf)))
    spark_tree = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, featuresCol="raw_features", labelCol="churn").fit(rows)
    theirs = {r.user_id: r.probability[1] for r in spark_tree.transform(rows).select("user_id", "probability").collect()}
    differ = [i for i, p in zip(pdf.user_id, ours) if abs(theirs[i] - p) > 1e-9]
    assert len(differ) <= 0.03 * len(pdf)  # splits of the same gain
    assert np.abs(fo.importances(t, stop, 5) - spark_tree.featureImportances.toArray()).max() < 0.03


def test_a_deep_tree_holds_the_shallow_ones(monkeypatch):
    pdf = _users(2000, whole=True)
    bins, counts, deep = _plain_tree(pdf, fo.Forest(1, 30, 2, 3))
    for depth in (1, 3, 7):
        t = fo.grow(bins, counts, fo.Forest(1, depth, 2, 3), 0)
        a, b = ((x, np.where(fo.leaves(x, depth), -1, x.left)) for x in (deep, t))
        assert (fo.votes(a[0].feature, a[0].split, a[1], fo.shares(a[0]), bins) == fo.votes(t.feature, t.split, b[1], fo.shares(t), bins)).all()
    assert (deep.n0 + deep.n1).min() >= 2 and (deep.n0[0], deep.n1[0]) == tuple(counts.sum(0))
    monkeypatch.setattr(fo, "HISTOGRAM", 100)  # a few nodes at a time
    again = _plain_tree(pdf, fo.Forest(1, 30, 2, 3))[2]
    assert (again.left == deep.left).all() and (again.n1 == deep.n1).all()


def test_cells_count_as_their_rows():
    """Rows of the same bins are one cell: the tree is that of the rows, and copies have the same mean and variance."""
    pdf = pd.concat([_users(200, whole=True)] * 3)
    bins, counts, t = _plain_tree(pdf, fo.Forest(1, 30, 1, 5))
    cells, at = np.unique(bins, axis=1, return_inverse=True)
    merged = np.stack([np.bincount(at.ravel(), counts[:, c]) for c in (0, 1)], 1)
    one = fo.grow(np.ascontiguousarray(cells), merged, fo.Forest(1, 30, 1, 5), 0)
    assert (one.left == t.left).all() and (one.n0 == t.n0).all() and (one.feature == t.feature).all()
    draws = np.concatenate([fo.bootstrap(np.full(200, 3), 42, i) for i in range(100)])
    assert abs(draws.mean() - 3) < 0.05 and abs(draws.var() - 3) < 0.15


def test_cuts_and_missing_values(spark, monkeypatch):
    pdf = _users(3000)
    pdf["frequency"] = np.arange(3000) % 7.0
    pdf.loc[:99, "monetary"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("event_count", F.when(F.col("user_id") >= 50, F.col("event_count")))
    for values in (10_000, 500):
        monkeypatch.setattr(fo, "VALUES", values)
        cuts = fo.cut_values(df, FEATURES)
        assert cuts[0].tolist() == [i + 0.5 for i in range(6)]
        assert all(len(c) == 31 for c in cuts[1:])
        share = np.searchsorted(cuts[2], pdf.session_duration.to_numpy())
        assert np.bincount(share).min() > 60 and np.bincount(share).max() < 130
    m = fo.fit_forest(churn.binary_label(df), FEATURES, "churn", fo.Forest(5, 30, 1, 3))
    assert m.transform(churn.binary_label(df)).where("prediction = churn").count() > 2400


def test_large_tables_keep_their_trees_off_the_driver(spark, monkeypatch, tmp_path):
    """above FOREST_ROWS the trees are rows of a table; figures as with Spark's forest, whatever the partitions."""
    df = spark.createDataFrame(_users(1500))
    before, spark_forest = churn.train_churn(df, models=["Random Forest"])
    monkeypatch.setattr(churn, "FOREST_ROWS", 500)
    rows, fitted = churn.train_churn(df, models=["Random Forest"])
    m = fitted["Random Forest"].stages[-1]
    assert isinstance(m, fo.ForestModel) and m.trees.count() == m.getNumTrees == 100
    assert all(abs(a - b) < 0.06 for a, b in zip(before[0][1:], rows[0][1:]))
    want, have = (dict(churn.feature_importance(x["Random Forest"])) for x in (spark_forest, fitted))
    assert set(have) == set(want) and all(abs(have[f] - want[f]) < 0.04 for f in want) and math.isclose(sum(have.values()), 1)
    monkeypatch.setattr(churn, "ROWS_A_TASK", 200)
    monkeypatch.setattr(fo, "PACK", 100)
    assert churn.train_churn(df.repartition(7), models=["Random Forest"])[0] == rows
    from sparkjourney.sources.writers import load_model, save_model
    save_model(fitted["Random Forest"], str(tmp_path / "m"))
    cols = ("user_id", "prediction", "probability", "rawPrediction")
    assert (sorted(load_model(str(tmp_path / "m")).transform(df).select(*cols).collect())
            == sorted(fitted["Random Forest"].transform(df).select(*cols).collect()))


def test_grid_of_large_tables(spark, monkeypatch):
    """a tree is grown once for all depths and sizes of forest; each figure is that of the forest on its own."""
    df = churn.binary_label(spark.createDataFrame(_users(900)))
    fit, held = df.where("user_id % 3 > 0"), df.where("user_id % 3 = 0")
    grid = [fo.Forest(n, d, least, s, 7) for n in (4, 10) for d in (30, 3) for least in (2, 20) for s in (2, 3)]
    areas = fo.grid_areas(fit, held, FEATURES, "churn", grid)
    for g, a in list(zip(grid, areas))[::5]:
        own = churn.evaluate(fo.fit_forest(fit, FEATURES, "churn", g).transform(held)).first()
        assert abs(own.roc_auc - a) < 1e-9
    monkeypatch.setattr(churn, "FOREST_ROWS", 500)
    params, metrics, cvm = churn.tune_forest(df, grid_kwargs=dict(trees=(5, 10), depths=(2, 30), min_instances=(1,)))
    assert len(cvm.avgMetrics) == len(cvm.stdMetrics) == len(cvm.getEstimatorParamMaps()) == 8
    assert max(cvm.avgMetrics) > 0.85 and metrics.roc_auc > 0.85
    assert isinstance(cvm.bestModel.stages[-1], fo.ForestModel) and cvm.bestModel.stages[-1].getNumTrees == params["numTrees"]


def test_tasks_of_a_fit_grow_with_the_cores_before_the_rows():
    """600 passes of the boosted trees over 540,000 users started 66 tasks each."""
    assert [churn.fit_tasks(n, 6) for n in (0, 1, 8192, 8193, 90_000, 540_000)] == [1, 1, 1, 2, 11, 18]
    assert churn.fit_tasks(540_000, 100) == 66 and churn.fit_tasks(10 ** 8, 6) == 96
