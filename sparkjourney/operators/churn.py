"""Churn modelling: user-level split, class weights, naive Bayes, Spark ML models.

Grain: one row per user (never per event), and the train/test split is by
user key, so no user can sit on both sides.  Both splits order users by the md5
of the key, so they are deterministic and independent of partitioning.
``stratified_split`` takes a share of the hash's values: no shuffle, and each
class is split in the same proportion in expectation.
``stratified_split_exact``, which the models use, takes the exact share of every
class: the hash at the wanted rank is selected by ranges (``select_ranks``), so
no class is sorted and none is one task.

Gaussian naive Bayes is written in closed form: one aggregate pass fits the
class priors, per-class means and variances (variance smoothing of
``1e-9 * largest feature variance``), and scoring is a column expression
with those numbers as literals.  The other models are Spark ML estimators trained on a
checkpointed feature table that every fit reuses.  Forests keep the node of each row
beside the row (``cacheNodeIds``): without it each pass sends all trees grown so far
to the tasks and walks every row down from the root.  Spark keeps all nodes of a forest
on the driver, and they grow with the rows: on more than ``FOREST_ROWS`` train rows the
same forest (its own draws) is grown and kept in tasks, see ``operators.forest``.
"""

from __future__ import annotations

from collections.abc import Sequence
import math

from pyspark.sql import DataFrame, functions as F

from sparkjourney import schema as S
from sparkjourney.operators.metrics import class_report, roc_auc
from sparkjourney.operators.forest import Forest, fit_forest, grid_areas
from sparkjourney.operators.quantiles import few, select_ranks
from sparkjourney.functions.scalar import with_scalar, fit_row

#: Spark's deepest tree, for "unbounded".
UNBOUNDED_DEPTH = 30

#: Rows for which a task of the fits is worth its start: a pass of a forest makes the
#: histograms of all its open nodes once a task, however few rows the task has.
ROWS_A_TASK = 8192

#: Tasks a core that the fits' rows make, and rows of a task at which they make more: a fit has
#: hundreds of passes, each of which starts all tasks and keeps a record of each on the driver.
TASKS_A_CORE = 3
MOST_ROWS_A_TASK = 1 << 20

#: Train rows up to which Spark grows a forest: its nodes (about one for each three rows
#: and tree) are all on the driver.
FOREST_ROWS = 2048

FEATURES = ("frequency", "monetary", "session_duration", "event_count", "product_count")


def hash_bucket(key, buckets: int = 100):
    """0..buckets-1 from the first 32 bits of md5 of the key's text."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
            % F.lit(buckets)).cast("int")


def stratified_split(df: DataFrame, key: str = S.USER, test_pct: int = 20, name: str = "split") -> DataFrame:
    """Add ``split`` = 'test' for ``test_pct`` % of keys (by hash), else 'train'."""
    return df.withColumn(name, F.when(hash_bucket(key) < test_pct, F.lit("test")).otherwise(F.lit("train")))


def split_hash(key):
    """The first 60 bits of md5 of the key's text."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("bigint")


def stratified_split_exact(df: DataFrame, label: str = "churn", key: str = S.USER, test_pct: int = 20,
                           name: str = "split") -> DataFrame:
    """Add ``split``: of every label's n rows, the n * ``test_pct`` / 100 (rounded
    half up) with the smallest hashes of the key are 'test', the others 'train'.

    Rows of one key stay together (so does, on a tie of 60 bits, the other key);
    rows with a NULL key are 'train'.  ``df`` is read four times: materialize it."""
    size = F.floor(F.col("n") * F.lit(test_pct / 100.0) + F.lit(0.5))
    cut = select_ranks(df.withColumn("_h", split_hash(key)), "_h", [size - 1], [label])
    cut = few(cut.select(F.col(label).alias("_label"), F.col("value").alias("_cut")), 2)
    return (df.join(cut, F.col(label).eqNullSafe(F.col("_label")), "left")
            .withColumn(name, F.when(split_hash(key) <= F.col("_cut"), F.lit("test")).otherwise(F.lit("train")))
            .drop("_label", "_cut"))


def _split(features_df: DataFrame, label: str, test_pct: int) -> DataFrame:
    """The models' input: one materialized table with the exact split."""
    from sparkjourney.session import materialize

    split = materialize(stratified_split_exact(materialize(features_df.drop("split")), label, test_pct=test_pct))
    return binary_label(split.coalesce(fit_tasks(split.count(), split.sparkSession.sparkContext.defaultParallelism)), label)


def fit_tasks(rows: int, cores: int) -> int:
    """Tasks that a fit's rows make."""
    return max(1, math.ceil(rows / MOST_ROWS_A_TASK), min(math.ceil(rows / ROWS_A_TASK), TASKS_A_CORE * cores))


def class_weights(df: DataFrame, label: str = "churn") -> DataFrame:
    """(label, n, weight) with balanced weights ``n_total / (n_classes * n_class)``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return (with_scalar(counts, "_t", tot)
            .withColumn("weight", F.col("_t")["total"] / (F.col("_t")["k"] * F.col("n"))).drop("_t"))


def with_weights(df: DataFrame, label: str = "churn", name: str = "weight") -> DataFrame:
    """Attach the balanced class weight of each row's label (k-row broadcast)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(F.broadcast(w), label)


def gaussian_nb(train: DataFrame, test: DataFrame, features: Sequence[str] = FEATURES, label: str = "churn",
                var_smoothing: float = 1e-9) -> DataFrame:
    """Binary Gaussian naive Bayes fitted on ``train``, applied to ``test``.

    Adds ``probability`` (of class 1) and ``prediction`` (class 1 only when
    its joint log-likelihood is strictly larger).
    """
    feats = list(features)
    x = {f: F.col(f).cast("double") for f in feats}
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n1")]
    for f in feats:
        aggs.append(F.var_pop(x[f]).alias(f"v_{f}"))
        for c in (0, 1):
            aggs.append(F.avg(F.when(F.col(label) == c, x[f])).alias(f"m{c}_{f}"))
            aggs.append(F.var_pop(F.when(F.col(label) == c, x[f])).alias(f"v{c}_{f}"))
    # fit: one row of sufficient statistics (2 + 5 * features numbers)
    p = fit_row(train.agg(*aggs))
    variances = [p[f"v_{f}"] for f in feats if p[f"v_{f}"] is not None]
    eps = var_smoothing * (max(variances) if variances else 0.0)
    n, n1 = p["n"], p["n1"]
    jll = {}
    for c in (0, 1):
        nc = n1 if c == 1 else n - n1
        s = F.lit(math.log(nc / n) if nc > 0 else float("-inf"))
        for f in feats:
            mean, var = p[f"m{c}_{f}"], p[f"v{c}_{f}"]
            if mean is None:  # class absent from the training data
                s = F.lit(float("-inf"))
                break
            var = var + eps
            s = s - F.lit(0.5 * math.log(2.0 * math.pi * var)) \
                - (x[f] - F.lit(mean)) * (x[f] - F.lit(mean)) / F.lit(2.0 * var)
        jll[c] = s
    return (test.withColumn("_j0", jll[0]).withColumn("_j1", jll[1])
            .withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_j0") - F.col("_j1"))))
            .withColumn("prediction", (F.col("_j1") > F.col("_j0")).cast("int"))
            .drop("_j0", "_j1"))


# --------------------------------------------------------------------------- Spark ML models

def binary_label(df: DataFrame, label: str = "churn") -> DataFrame:
    """Label as DOUBLE tagged as a 2-valued nominal attribute, so Spark ML
    builds binary models even when a training fold holds a single class."""
    meta = {"ml_attr": {"type": "nominal", "num_vals": 2, "name": label}}
    return df.withColumn(label, F.col(label).cast("double").alias(label, metadata=meta))


def _assembler(features: Sequence[str]):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep")


def _scaler():
    from pyspark.ml.feature import StandardScaler
    return StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)


def balance_by_replication(train: DataFrame, label: str = "churn", key: str = S.USER) -> DataFrame:
    """Replicate the minority-class rows ``n_major / n_minor`` times (for
    estimators without a weight column): the whole part for every row, and one
    copy more for the share of keys, by hash, that the fraction asks for."""
    cnt = train.agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    t = with_scalar(train, "_c", cnt)
    n1, n0 = F.col("_c")["n1"], F.col("_c")["n0"]
    minority = F.when(n1 < n0, F.lit(1)).otherwise(F.lit(0))
    ratio = F.greatest(n0, n1) / F.greatest(F.least(n0, n1), F.lit(1))
    share = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    factor = F.floor(ratio) + (share < ratio - F.floor(ratio)).cast("int")
    reps = F.when(F.col(label) == minority, factor.cast("int")).otherwise(F.lit(1))
    return t.withColumn("_rep", F.explode(F.array_repeat(F.lit(1), reps))).drop("_rep", "_c")


def model_zoo(features: Sequence[str], label: str = "churn", seed: int = 42) -> dict:
    """Name -> (Pipeline, needs balancing by replication)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier, GBTClassifier, NaiveBayes, MultilayerPerceptronClassifier
    k = len(list(features))
    asm = _assembler(features)
    raw = dict(featuresCol="raw_features", labelCol=label)
    scaled = dict(featuresCol="features", labelCol=label)
    return {
        "Random Forest": (Pipeline(stages=[asm, RandomForestClassifier(
            numTrees=100, maxDepth=UNBOUNDED_DEPTH, cacheNodeIds=True, seed=seed, **raw)]), False),
        "Gradient Boosted Trees": (Pipeline(stages=[asm, GBTClassifier(
            maxIter=100, maxDepth=6, stepSize=0.3, seed=seed, **raw)]), False),
        "Naive Bayes": (Pipeline(stages=[asm, NaiveBayes(modelType="gaussian", **raw)]), False),
        "SVM": (kernel_svm(features, label, seed), False),
        "Neural Network": (Pipeline(stages=[asm, _scaler(), MultilayerPerceptronClassifier(
            layers=[k, 32, 16, 2], maxIter=200, blockSize=32, seed=seed, **scaled)]), True),
    }


def kernel_svm(features: Sequence[str], label: str = "churn", seed: int = 42, number: int = 256, gamma: float = 0.0):
    """Support vector machine with a Gaussian kernel: scaled columns, random Fourier
    features, balanced linear machine."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC
    from sparkjourney.operators.fourier import FourierFeatures
    fourier = FourierFeatures(inputCol="features", outputCol="kernel_features", dimensions=len(list(features)), number=number, gamma=gamma, seed=seed)
    return Pipeline(stages=[_assembler(features), _scaler(), fourier, LinearSVC(weightCol="weight", featuresCol="kernel_features", labelCol=label)])


def with_probability(pipeline, train: DataFrame, label: str = "churn", key: str = S.USER, folds: int = 3):
    """The pipeline fitted on ``train``, with a last stage that turns its raw margin
    into a ``probability``: a logistic curve (Platt) over the margins that models of
    the other folds give, so no margin is of a row that its model has seen.  Folds
    are by the key's hash, and only ``train`` is used."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from sparkjourney.session import materialize

    fold = F.pmod(F.xxhash64(F.col(key), F.lit("fold")), F.lit(folds))
    margins = None
    for k in range(folds):
        rest, own = train.where(fold != k), train.where(fold == k)
        if rest.select(label).distinct().count() < 2:
            continue
        out = pipeline.fit(rest).transform(own).select("rawPrediction", label)
        margins = out if margins is None else margins.unionByName(out)
    fitted = pipeline.fit(train)
    if margins is None:
        return fitted
    platt = LogisticRegression(featuresCol="rawPrediction", labelCol=label, rawPredictionCol="_logit", probabilityCol="probability", predictionCol="_likely", regParam=1e-6)
    return PipelineModel([*fitted.stages, platt.fit(materialize(margins))])


def class1_score(pred: DataFrame, name: str = "score") -> DataFrame:
    """Class-1 score: probability when the model has one, else raw margin."""
    from pyspark.ml.functions import vector_to_array
    col = "probability" if "probability" in pred.columns else "rawPrediction"
    return pred.withColumn(name, vector_to_array(F.col(col))[1])


def evaluate(pred: DataFrame, label: str = "churn") -> DataFrame:
    """(accuracy, precision, recall, f1, roc_auc) for class 1, one row.  The model is
    applied once: its predictions are materialized for the figures that follow."""
    from sparkjourney.session import materialize

    p = materialize(class1_score(pred).select(label, F.col("prediction").cast("int").alias("prediction"), "score"))
    rep = class_report(p, label, "prediction")
    one = rep.agg(F.max(F.when(F.col("row") == "accuracy", F.col("f1"))).alias("accuracy"),
                  F.max(F.when(F.col("row") == "1", F.col("precision"))).alias("precision"),
                  F.max(F.when(F.col("row") == "1", F.col("recall"))).alias("recall"),
                  F.max(F.when(F.col("row") == "1", F.col("f1"))).alias("f1"))
    auc = roc_auc(p, label, "score").select(F.col("auc").alias("roc_auc")).scalar()
    return one.withColumn("roc_auc", auc)


def train_churn(features_df: DataFrame, label: str = "churn", features: Sequence[str] = FEATURES,
                models: Sequence[str] | None = None, test_pct: int = 20, seed: int = 42, parallelism: int = 4):
    """Fit every model on the train split and score the test split.

    Returns (metrics rows [(model, accuracy, precision, recall, f1, roc_auc)],
    fitted models by name).
    """
    data = _split(features_df, label, test_pct)
    # balanced weights come from the train labels alone
    train, test = with_weights(data.where(F.col("split") == "train"), label), data.where(F.col("split") == "test")
    from concurrent.futures import ThreadPoolExecutor

    zoo = [(n, p, b) for n, (p, b) in model_zoo(features, label, seed).items() if not models or n in models]

    def fit_one(item):
        name, pipe, balance = item
        if name == "SVM":
            m = with_probability(pipe, train, label)
        elif name == "Random Forest" and many_rows(train):
            m = forest_in_tasks(pipe.getStages()[-1], train, features, label)
        else:
            m = pipe.fit(balance_by_replication(train, label) if balance else train)
        r = evaluate(m.transform(test), label).first()
        return (name, *[float(v) if v is not None else None for v in r]), m

    # independent fits on the same checkpointed table, submitted concurrently
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(zoo)))) as pool:
        done = list(pool.map(fit_one, zoo))
    return [r for r, _ in done], {r[0]: m for r, m in done}


def many_rows(train: DataFrame) -> bool:
    """Whether a forest of these rows is grown in tasks."""
    return train.count() > FOREST_ROWS


def forest_in_tasks(rf, train: DataFrame, features: Sequence[str], label: str):
    """Pipeline model of the forest that Spark's estimator ``rf`` describes, grown and kept in tasks."""
    from pyspark.ml import PipelineModel
    return PipelineModel([_assembler(features), fit_forest(train, features, label, forest_of(rf, {}, len(list(features))))])


def forest_of(rf, point: dict, n: int) -> Forest:
    """Spark's estimator at a point of its grid, for ``n`` columns."""
    at = {p.name: v for p, v in rf.extractParamMap(point).items()}
    return Forest(at["numTrees"], at["maxDepth"], at["minInstancesPerNode"], split_columns(at["featureSubsetStrategy"], n), at["seed"])


def split_columns(strategy: str, n: int) -> int:
    """Columns of ``n`` that a split of a forest looks at, as Spark reads the strategy."""
    known = {"auto": "sqrt", "sqrt": "sqrt", "log2": "log2"}
    if strategy in known:
        return subset_size(known[strategy], n)
    if strategy in ("all", "onethird"):
        return n if strategy == "all" else math.ceil(n / 3)
    return min(n, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * n)


def feature_importance(forest_pipeline_model, features: Sequence[str] = FEATURES) -> list[tuple[str, float]]:
    """(feature, importance) from a fitted forest pipeline, largest first."""
    imp = forest_pipeline_model.stages[-1].featureImportances.toArray()
    return sorted(zip(list(features), map(float, imp)), key=lambda t: (-t[1], t[0]))


def forest_grid(label: str = "churn", seed: int = 42, trees=(100, 200), depths=(UNBOUNDED_DEPTH, 10, 20),
                min_instances=(2, 5, 10), subsets=("sqrt", "log2")):
    """Random-forest estimator and its parameter grid (depth 30 stands for
    'unbounded', Spark's maximum)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.tuning import ParamGridBuilder
    rf = RandomForestClassifier(seed=seed, cacheNodeIds=True, featuresCol="raw_features", labelCol=label)
    grid = (ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths))
            .addGrid(rf.minInstancesPerNode, list(min_instances))
            .addGrid(rf.featureSubsetStrategy, list(subsets)).build())
    return rf, grid


def subset_size(strategy: str, n: int) -> int | str:
    """Columns that a split looks at under Spark's ``featureSubsetStrategy``, or the
    strategy itself where that depends on more than the number of columns."""
    if strategy not in ("sqrt", "log2"):
        return strategy
    return math.ceil(math.sqrt(n)) if strategy == "sqrt" else max(1, math.ceil(math.log(n) / math.log(2)))


def same_forest(grid: Sequence[dict], n: int) -> list[int]:
    """For each point of the grid the first point whose forest it shares: with the same
    seed, points that differ in the name of an equally large subset grow the same trees."""
    def grown(point):
        return frozenset((p.name, subset_size(v, n) if p.name == "featureSubsetStrategy" else v) for p, v in point.items())

    first: dict = {}
    return [first.setdefault(grown(point), i) for i, point in enumerate(grid)]


def tune_forest(features_df: DataFrame, label: str = "churn", features: Sequence[str] = FEATURES, folds: int = 3,
                parallelism: int = 4, seed: int = 42, grid_kwargs: dict | None = None):
    """3-fold cross-validated grid search on the train split, by ROC AUC.  Points of
    the grid that grow the same forest share its fits; each has its own figure.

    Returns (best params dict, test metrics row, cv model).
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    data = _split(features_df, label, 20)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    rf, grid = forest_grid(label, seed, **(grid_kwargs or {}))
    shared = same_forest(grid, len(list(features)))
    fitted = sorted(set(shared))
    cv = CrossValidator(estimator=Pipeline(stages=[_assembler(features), rf]), estimatorParamMaps=[grid[i] for i in fitted],
                        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"),
                        numFolds=folds, parallelism=parallelism, seed=seed)
    cvm = _grid_in_tasks(cv, train, features, label) if many_rows(train) else cv.fit(train)
    at = {i: j for j, i in enumerate(fitted)}
    cvm.avgMetrics, cvm.stdMetrics = ([m[at[i]] for i in shared] if m else m for m in (cvm.avgMetrics, cvm.stdMetrics))
    cvm._set(estimatorParamMaps=grid)
    best = {p.name: v for p, v in rf.extractParamMap(grid[max(range(len(grid)), key=lambda i: cvm.avgMetrics[i])]).items()}
    params = {name: best[name] for name in ("numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy")}
    metrics = evaluate(cvm.bestModel.transform(test), label).first()
    return params, metrics, cvm


def _grid_in_tasks(cv, train: DataFrame, features: Sequence[str], label: str):
    """What ``cv.fit(train)`` gives, with the same folds, for forests that are grown in tasks."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.tuning import CrossValidatorModel

    points, rf, n = cv.getEstimatorParamMaps(), cv.getEstimator().getStages()[-1], len(list(features))
    forests = [forest_of(rf, point, n) for point in points]
    areas = [grid_areas(fit, held, features, label, forests) for fit, held in cv._kFold(train)]
    by_point = list(zip(*areas))
    avg = [sum(a) / len(a) for a in by_point]
    std = [math.sqrt(sum((x - m) ** 2 for x in a) / len(a)) for a, m in zip(by_point, avg)]
    best = forests[max(range(len(avg)), key=avg.__getitem__)]
    model = PipelineModel([_assembler(features), fit_forest(train, features, label, best)])
    return CrossValidatorModel(model, avg, None, std)


def network_loss_history(features_df: DataFrame, label: str = "churn", features: Sequence[str] = FEATURES,
                         test_pct: int = 20, seed: int = 42) -> list[tuple[int, float]]:
    """(iteration, training loss) of the multilayer perceptron, trained on the
    balanced train split (Spark keeps the training objective only)."""
    train = _split(features_df, label, test_pct).where(F.col("split") == "train")
    pipe, _ = model_zoo(features, label, seed)["Neural Network"]
    m = pipe.fit(balance_by_replication(train, label))
    hist = m.stages[-1].summary().objectiveHistory
    return [(i + 1, float(v)) for i, v in enumerate(hist)]
