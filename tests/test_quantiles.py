import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from sparkjourney.operators.quantiles import exact_quantiles, grouped_running_totals, select_ranks

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "x": np.round(rng.exponential(10, 3000), 1)})
    pdf.loc[:900, "x"] = 0.0  # a heavy tie
    return pdf, spark.createDataFrame(pdf)


def test_grouped_quantiles_equal_numpy(data):
    pdf, df = data
    got = exact_quantiles(df, "x", PROBS, ["g"], buckets=8).toPandas()
    assert len(got) == 3 * len(PROBS)
    for _, r in got.iterrows():
        assert abs(np.percentile(pdf.loc[pdf.g == r["g"], "x"], 100 * r["q"]) - r["quantile"]) < 1e-9


def test_ungrouped_quantiles_equal_numpy(data):
    pdf, df = data
    got = exact_quantiles(df, "x", PROBS, buckets=5).toPandas()
    for _, r in got.iterrows():
        assert abs(np.percentile(pdf["x"], 100 * r["q"]) - r["quantile"]) < 1e-9


def test_grouped_running_totals(spark):
    pdf = pd.DataFrame({"g": [1, 1, 1, 2, 2], "k": [3.0, 1.0, 2.0, 5.0, 4.0], "v": [1, 2, 3, 4, 5]})
    got = grouped_running_totals(spark.createDataFrame(pdf), ["g"], "k", ["v"], buckets=2).toPandas()
    got = got.sort_values(["g", "k"])
    assert got["v_cum"].tolist() == [2, 5, 6, 5, 9]


@pytest.mark.parametrize("buckets", [1, 4, 50, None])
def test_selected_ranks_equal_a_sort(data, buckets):
    pdf, df = data
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))  # a null group is a group
    got = {(r.g, r["rank"]): (r.n, r.value) for r in select_ranks(df, "x", [F.lit(0), F.lit(7), F.col("n") - 1, F.col("n") + 5, F.lit(-1)], ["g"], buckets).collect()}
    for g, v in pdf.groupby("g")["x"]:
        v = sorted(v)
        for r in (0, 7, len(v) - 1):
            assert got.pop((int(g) or None, r)) == (len(v), v[r])
    assert not got


def test_selection_of_large_integers_is_exact(spark):
    keys = [2**60 + i for i in range(500)]  # alike as doubles
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert select_ranks(df, "k", [F.lit(123)]).first().value == keys[123]


def test_values_outside_the_wanted_ranges_are_not_shuffled(spark):
    df = spark.range(200_000).selectExpr("id % 3 AS g", "rand(1) * 1000 AS x").repartition(4)
    out = exact_quantiles(df, "x", [0.25, 0.5, 0.75], ["g"], buckets=64)
    out.collect()
    seen = []

    def walk(node):
        name = node.nodeName()
        if name == "Exchange":
            seen.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = [node.children().apply(i) for i in range(node.children().size())]
        for inner in ("executedPlan", "plan"):
            if "AdaptiveSparkPlan" in name and inner == "executedPlan" or "QueryStage" in name and inner == "plan":
                children = [getattr(node, inner)()]
        for c in children:
            walk(c)

    walk(out._jdf.queryExecution().executedPlan())
    assert max(x for x in seen if x != 200_000) < 40_000  # besides the fixture's own repartition


def test_no_values_give_no_quantiles(spark):
    df = spark.createDataFrame([(1, None)], "g int, x double")
    assert exact_quantiles(df, "x", [0.5], ["g"]).collect() == [] and exact_quantiles(df, "x", [0.5]).collect() == []
