"""Forests of the churn models: what a pass sends, what a grid fits, how often a model is applied."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkjourney.operators import churn


@pytest.fixture(scope="module")
def users(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 200)
    pdf = pd.DataFrame(rng.normal(0, 1, (200, 5)) + 0.7 * y[:, None], columns=list(churn.FEATURES))
    pdf["user_id"], pdf["churn"] = np.arange(200, dtype="int64"), y.astype("int32")
    return spark.createDataFrame(pdf)


def _trees(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.trees]


def test_forests_keep_the_node_of_each_row(users):
    """without it the trees grown so far go to the tasks again at each pass."""
    from pyspark.ml.classification import RandomForestClassifier
    assert churn.model_zoo(churn.FEATURES)["Random Forest"][0].getStages()[-1].getCacheNodeIds()
    assert churn.forest_grid()[0].getCacheNodeIds()
    rows = churn._assembler(churn.FEATURES).transform(churn.binary_label(users.repartition(3, "user_id"))).cache()
    rf = RandomForestClassifier(numTrees=4, maxDepth=30, seed=1, featuresCol="raw_features", labelCol="churn")
    assert _trees(rf.copy({rf.cacheNodeIds: True}).fit(rows)) == _trees(rf.copy({rf.cacheNodeIds: False}).fit(rows))


def test_a_model_is_applied_once_for_all_figures(spark, users):
    """each row's prediction is made once, whatever the figures read."""
    made = spark.sparkContext.accumulator(0)

    def score(x):
        made.add(1)
        return float(x)

    pred = users.withColumn("s", F.udf(score, "double")("frequency")).select(
        "churn", (F.col("s") > 0).cast("double").alias("prediction"), F.array(-F.col("s"), F.col("s")).alias("raw"))
    from pyspark.ml.functions import array_to_vector
    out = churn.evaluate(pred.select("churn", "prediction", array_to_vector("raw").alias("rawPrediction"))).first()
    assert 0.5 < out.roc_auc <= 1 and 0 < out.f1 <= 1
    assert made.value == users.count()


def test_points_of_one_forest_share_its_fits(users):
    """with 5 columns the subsets of sqrt and log2 have 3 columns each, and the trees are the same."""
    _, grid = churn.forest_grid()
    shared = churn.same_forest(grid, 5)
    assert (len(grid), len(set(shared))) == (36, 18)
    assert len(set(churn.same_forest(grid, 9))) == 36  # 3 and 4 columns
    for i, j in enumerate(shared):
        assert {p.name: v for p, v in grid[i].items() if p.name != "featureSubsetStrategy"} == {
            p.name: v for p, v in grid[j].items() if p.name != "featureSubsetStrategy"}
    rows = churn._assembler(churn.FEATURES).transform(churn.binary_label(users)).cache()
    rf, pair = churn.forest_grid(trees=(3,), depths=(30,), min_instances=(2,))
    assert _trees(rf.fit(rows, pair[0])) == _trees(rf.fit(rows, pair[1]))
    params, _, cvm = churn.tune_forest(users, folds=2, grid_kwargs=dict(trees=(3,), depths=(2, 4), min_instances=(1,)))
    assert len(cvm.avgMetrics) == len(cvm.getEstimatorParamMaps()) == 4
    by = {(m[k[0]], m[k[1]]): v for m, v in zip(cvm.getEstimatorParamMaps(), cvm.avgMetrics)
          for k in [sorted((p for p in m if p.name in ("maxDepth", "featureSubsetStrategy")), key=lambda p: p.name)]}
    assert by["sqrt", 2] == by["log2", 2] and by["sqrt", 4] == by["log2", 4]
    assert params["featureSubsetStrategy"] == "sqrt" and by["sqrt", params["maxDepth"]] == max(cvm.avgMetrics)
