import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkjourney.operators.stats import standardize, describe, histogram, box_stats, correlation
from sparkjourney.operators.marts import churn_from_action, overview, flag_members
from sparkjourney.operators.segments import marketing_actions, nearest_centroid
from sparkjourney.operators.rfm import rfm, churn_label
from sparkjourney.sources.profile import null_profile


def test_constant_column_zscore_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    assert [r.x_z for r in standardize(df, ["x"]).collect()] == [0.0, 0.0]


def test_describe_and_histogram_match_numpy(spark):
    x = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34], dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    d = describe(df, "x").first()
    assert d["count"] == 10 and abs(d["std"] - x.std(ddof=1)) < 1e-12
    assert abs(d["p95"] - np.percentile(x, 95)) < 1e-12 and abs(d["p50"] - np.median(x)) < 1e-12
    h = histogram(df, "x", bins=5).orderBy("bin").collect()
    counts, _ = np.histogram(x, bins=5)
    assert [r.n for r in h] == counts.tolist()


def test_box_stats_whiskers(spark):
    x = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(0, v) for v in x], "churn int, f double")
    r = box_stats(df, "churn", ["f"]).first()
    assert (r.q1, r.median, r.q3) == (2.0, 3.0, 4.0)
    assert (r.lower_whisker, r.upper_whisker, r.n_outliers) == (1.0, 4.0, 1)


def test_correlation_diagonal(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0)], "a double, b double")
    c = {(r.row_feature, r.col_feature): r.corr for r in correlation(df, ["a", "b"]).collect()}
    assert abs(c[("a", "a")] - 1.0) < 1e-12 and abs(c[("a", "b")] - c[("b", "a")]) < 1e-12


def test_rfm_null_amount_and_recency_floor(spark):
    import datetime as dt
    ref = dt.datetime(2024, 1, 10)
    ev = spark.createDataFrame([
        (1, 1, ref - dt.timedelta(days=6, hours=23), None, 0),
        (2, 2, ref - dt.timedelta(days=7), 3.5, 0),
        (3, 3, ref, 1.0, 0), (4, 3, ref, 2.0, 1)],
        "event_id long, user_id long, ts timestamp_ntz, amount double, session_id long")
    got = {r.user_id: (r.recency, r.frequency, r.monetary, r.churn) for r in churn_label(rfm(ev), 7).collect()}
    assert got == {1: (6, 1, 0.0, 0), 2: (7, 1, 3.5, 1), 3: (0, 2, 3.0, 0)}


def test_actions_unmapped_cluster_regex_churn_and_overview(spark):
    seg = spark.createDataFrame([(1, 1, 1, 1.0, 2), (2, 1, 1, 1.0, 7), (3, 1, 1, 1.0, 0)],
                                "user_id long, recency long, frequency long, monetary double, cluster int")
    act = churn_from_action(marketing_actions(seg))
    got = {r.user_id: (r.marketing_action is None, r.churn) for r in act.collect()}
    assert got == {1: (False, 1), 2: (True, 0), 3: (False, 0)}
    o = overview(act).first()
    assert (o.total_users, o.churned_users, o.active_users) == (3, 1, 2)
    flagged = flag_members(seg, spark.createDataFrame([(2,), (2,)], "user_id long"), "hit")
    assert {r.user_id: r.hit for r in flagged.collect()} == {1: False, 2: True, 3: False}


def test_nearest_centroid_tie_goes_to_lowest_id(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (0.9,)], "x double")
    got = [r.cluster for r in nearest_centroid(df, ["x"], [[-1.0], [1.0], [1.0]]).collect()]
    assert got == [0, 1, 1]


def test_null_profile_positive_only(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {r.column: r.null_count for r in null_profile(df).collect()} == {"a": 1, "b": 2}
    assert null_profile(df.where(F.col("a") == 3)).count() == 0


def test_rfm_event_grain(spark):
    import datetime as dt
    ref = dt.datetime(2024, 1, 10)
    ev = spark.createDataFrame([(1, 1, ref, 1.0, 0), (2, 1, ref, 2.0, 1), (3, 2, ref, None, 0)],
                               "event_id long, user_id long, ts timestamp_ntz, amount double, session_id long")
    got = {r.event_id: (r.frequency, r.monetary) for r in rfm(ev, grain="event").collect()}
    assert got == {1: (2, 3.0), 2: (2, 3.0), 3: (1, 0.0)}


def test_scaler_stats_roundtrip(spark):
    from sparkjourney.operators.stats import scaler_stats, apply_scaler
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, x double, c double")
    a = {r.id: (r.x_z, r.c_z) for r in apply_scaler(df, scaler_stats(df, ["x", "c"]), ["x", "c"]).collect()}
    b = {r.id: (r.x_z, r.c_z) for r in standardize(df, ["x", "c"]).collect()}
    assert a == b == {1: (-1.0, 0.0), 2: (1.0, 0.0)}
