"""Model sanity on synthetic data with known structure."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkjourney.operators.churn import gaussian_nb, stratified_split, train_churn, binary_label
from sparkjourney.operators.kmeans import kmeans_sweep, lloyd, seed_centres, silhouettes
from sparkjourney.operators.segments import fit_pca, project, segment
from sparkjourney.sources import with_defaults, require_columns

FEATS = ["frequency", "monetary", "session_duration", "event_count", "product_count"]


def _separable(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(0, 1, (n, len(FEATS))) + 3.0 * y[:, None]
    pdf = pd.DataFrame(x, columns=FEATS)
    pdf["user_id"] = np.arange(n, dtype="int64")
    pdf["churn"] = y.astype("int32")
    return spark.createDataFrame(pdf)


def test_closed_form_nb_matches_spark_ml(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    df = stratified_split(_separable(spark, seed=1))
    tr, te = df.where("split = 'train'"), df.where("split = 'test'")
    ours = gaussian_nb(tr, te, FEATS, "churn").select("user_id", "probability", "prediction")
    ml = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="v"),
                          NaiveBayes(modelType="gaussian", featuresCol="v", labelCol="churn")]) \
        .fit(binary_label(tr, "churn")).transform(te) \
        .select("user_id", vector_to_array("probability")[1].alias("p_ml"), F.col("prediction").alias("y_ml"))
    j = ours.join(ml, "user_id").toPandas()
    assert len(j) == te.count()
    assert (j["prediction"] == j["y_ml"]).mean() > 0.99
    assert np.allclose(j["probability"], j["p_ml"], atol=1e-6)


def test_models_learn_separable_data(spark):
    rows, _ = train_churn(_separable(spark, seed=2), models=["Random Forest", "Naive Bayes", "SVM"])
    for name, acc, prec, rec, f1, auc in rows:
        assert auc > 0.9, name
        assert acc > 0.8, name


def test_kmeans_finds_three_blobs(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [10, 10, 10], [-10, 10, -10]])
    pts = np.vstack([c + rng.normal(0, 0.5, (60, 3)) for c in centres])
    pdf = pd.DataFrame(pts, columns=["recency", "frequency", "monetary"])
    pdf["user_id"] = np.arange(len(pdf), dtype="int64")
    df = spark.createDataFrame(pdf)
    seg, rows, k = segment(df, ks=range(2, 6), n_init=2)
    assert k == 3
    costs = [r[1] for r in rows]
    assert costs == sorted(costs, reverse=True)
    # re-ranked: cluster 0 has the largest mean monetary
    prof = seg.groupBy("cluster").agg(F.avg("monetary").alias("m")).orderBy("cluster").toPandas()
    assert list(prof["m"]) == sorted(prof["m"], reverse=True)
    assert seg.count() == len(pdf)


def _ring(spark, seed, n=400):
    """Label 1 inside a ring of label 0: no line tells them apart."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    r, a = np.where(y == 1, 0.0, 3.0) + rng.normal(0, 0.5, n), rng.uniform(0, 2 * np.pi, n)
    pdf = pd.DataFrame({"a": r * np.cos(a), "b": r * np.sin(a), "user_id": np.arange(n, dtype="int64"), "churn": y.astype("int32")})
    return spark.createDataFrame(pdf).withColumn("weight", F.lit(1.0))


def test_kernel_machine_learns_a_ring(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LinearSVC
    from sparkjourney.operators.churn import _assembler, _scaler, class1_score, kernel_svm, with_probability
    from sparkjourney.operators.metrics import confusion, predict_at, roc_auc
    df = binary_label(_ring(spark, 5)).cache()
    train, test = df.where("user_id % 4 > 0"), df.where("user_id % 4 = 0")
    linear = Pipeline(stages=[_assembler(["a", "b"]), _scaler(), LinearSVC(weightCol="weight", featuresCol="features", labelCol="churn")]).fit(train)
    auc = lambda m: roc_auc(class1_score(m.transform(test)), "churn", "score").first().auc
    assert abs(auc(linear) - 0.5) < 0.2
    model = with_probability(kernel_svm(["a", "b"], number=64), train, folds=2)
    assert auc(model) > 0.95
    scored = class1_score(model.transform(test))
    got = scored.select("user_id", "churn", "score").toPandas()
    assert got["score"].between(0, 1).all()
    assert abs(got["score"].mean() - got["churn"].mean()) < 0.1  # calibrated in the large
    c = {(int(r.churn), r.prediction): r.n for r in confusion(predict_at(scored.select("churn", "score"), "score", 0.5), "churn", "prediction").collect()}
    assert (c[0, 0] + c[1, 1]) / sum(c.values()) > 0.9
    model.write().overwrite().save(str(tmp_path / "m"))
    again = class1_score(PipelineModel.load(str(tmp_path / "m")).transform(test)).select("user_id", "score").toPandas()
    assert np.allclose(again.sort_values("user_id")["score"], got.sort_values("user_id")["score"])


def _blobs(spark, seed, n=90):
    rng = np.random.default_rng(seed)
    x = np.vstack([c + rng.normal(0, 0.7, (n // 3, 2)) for c in ([0, 0], [6, 1], [2, 7])])
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf["user_id"] = np.arange(len(x), dtype="int64")
    return x, spark.createDataFrame(pdf).repartition(5)


def _far(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(2)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_models_move_as_one_alone_does(spark, seed):
    x, df = _blobs(spark, seed)
    rng = np.random.default_rng(seed)
    models = {(k, s): x[rng.choice(len(x), k, replace=False)] for k in (2, 3, 5) for s in range(3)}
    models[5, 0] = np.vstack([models[5, 0][:4], [[99.0, 99.0]]])  # a centre without rows stays
    got, inertia = lloyd(df, ["a", "b"], models, 4, 0.0)
    sil = silhouettes(df, ["a", "b"], got)
    for m, c in models.items():
        for _ in range(4):
            near = _far(x, c).argmin(1)
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        assert np.allclose(got[m], c)
        far = _far(x, c)
        near = far.argmin(1)
        assert np.isclose(inertia[m], far.min(1).sum())
        pair, each = _far(x, x), []
        for i in range(len(x)):
            own = near == near[i]
            a = pair[i][own].sum() / max(own.sum() - 1, 1)
            b = min([pair[i][near == j].mean() for j in range(len(c)) if j != near[i] and (near == j).any()])
            each.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
        assert np.isclose(sil[m], np.mean(each))


def test_sweep_is_a_few_scans_and_ignores_partitions(spark):
    x, df = _blobs(spark, 3)
    rows, models = kmeans_sweep(df, ["a", "b"], "user_id", range(2, 6), n_init=4)
    again, _ = kmeans_sweep(df.coalesce(1), ["a", "b"], "user_id", range(2, 6), n_init=4)
    assert np.allclose(rows, again)
    assert max(rows, key=lambda r: r[2])[0] == 3
    assert [r[1] for r in rows] == sorted((r[1] for r in rows), reverse=True)
    assert np.allclose(sorted(models[3].tolist()), sorted([x[:30].mean(0).tolist(), x[30:60].mean(0).tolist(), x[60:].mean(0).tolist()]))


def test_fewer_rows_than_centres_and_missing_values(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 5.0), (4, None), (5, float("nan"))], "user_id long, a double")
    assert [len(c) for c in seed_centres(df, ["a"], "user_id", 4, 3)] == [2, 2, 2]
    rows, models = kmeans_sweep(df, ["a"], "user_id", (2, 4), n_init=2)
    assert sorted(models[4].tolist()) == [[0.0], [5.0]] and rows[0][1] == 0
    assert kmeans_sweep(df.where("a > 99"), ["a"], "user_id", (2,)) == ([], {})


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (200, 4)) @ rng.normal(0, 1, (4, 4)) + 3
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    pca = fit_pca(df, list("abcd"), 2)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(pca.share, (s ** 2 / (s ** 2).sum())[:2])
    assert np.allclose(np.abs(pca.components @ vt[:2].T), np.eye(2), atol=1e-8)
    got = project(df, list("abcd"), pca).select("pc1", "pc2").toPandas().to_numpy()
    assert np.allclose(got, (x - x.mean(0)) @ pca.components.T)


def test_defaults_and_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert with_defaults(df, ["a", "b"], 0).first().asDict() == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        require_columns(df, ["a", "zz"])


def test_nearest_centre_takes_no_block_of_rows_by_centres_by_columns():
    import tracemalloc
    from sparkjourney.operators.kmeans import _nearest
    rng = np.random.default_rng(4)
    x, c = rng.integers(0, 5, (50_000, 3)).astype(float), rng.integers(0, 5, (10, 3)).astype(float)  # many ties
    tracemalloc.start()
    near, low = _nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    far = _far(x, c)
    assert (near == far.argmin(1)).all() and (low == far.min(1)).all()
    assert peak < far.nbytes  # the block and its squares are six times as large
