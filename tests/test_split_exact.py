"""The exact stratified split: shares to one row, whatever the partitions and ranges."""

import pytest
from pyspark.sql import functions as F

from sparkjourney.operators.churn import stratified_split_exact


@pytest.mark.parametrize("pct", [1, 20, 50, 100])
def test_test_share_of_each_class_is_exact(spark, pct):
    df = spark.range(3001).selectExpr("id AS user_id", "CASE WHEN id % 300 = 0 THEN NULL WHEN id % 7 = 0 THEN 1 ELSE 0 END AS churn")
    got = stratified_split_exact(df, test_pct=pct).groupBy("churn").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()
    assert len(got) == 3 and all(r.t == int(r.n * pct / 100 + 0.5) for r in got)


def test_split_ignores_partitions_and_extra_columns(spark):
    df = spark.range(500).selectExpr("id AS user_id", "int(id % 9 = 0) AS churn", "id AS n", "id AS value")
    one = sorted(map(tuple, stratified_split_exact(df.repartition(1)).collect()))
    assert one == sorted(map(tuple, stratified_split_exact(df.repartition(13)).collect())) and len(one) == 500


def test_small_classes_and_missing_keys(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (None, 0), (3, 1)], "user_id long, churn int")
    got = {(r.user_id, r.churn): r.split for r in stratified_split_exact(df).collect()}
    assert set(got.values()) == {"train"} and len(got) == 4  # a fifth of two rows rounds to none
    assert stratified_split_exact(df.where("false")).count() == 0
