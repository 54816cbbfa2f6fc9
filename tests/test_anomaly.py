import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sparkjourney.operators.anomaly import (
    _c, _grow, event_spikes, isolation_forest, score_forest, spike_share, suspicious_timeline,
)

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string"
T0 = dt.datetime(2024, 1, 1)


def test_spike_threshold_is_strict(spark):
    # per-user click counts 1..20: p95 = 19.05 -> only the user with 20
    rows, i = [], 0
    for u in range(1, 21):
        for k in range(u):
            rows.append((i, u, T0 + dt.timedelta(minutes=i), "click")); i += 1
    rows.append((i, 99, T0, "view"))
    ev = spark.createDataFrame(rows, SCHEMA)
    assert [(r.user_id, r.event_count) for r in event_spikes(ev, ["click"], 0.95).collect()] == [(20, 20)]
    # a count exactly at the percentile is not a spike: counts 1..3 and q=0.5 -> threshold 2
    small = ev.where(F.col("user_id") <= 3)
    assert sorted(r.user_id for r in event_spikes(small, ["click"], 0.5).collect()) == [3]
    sh = {r.category: (r.users, r.share) for r in spike_share(ev, event_spikes(ev, ["click"])).collect()}
    assert sh == {"Normal Users": (20, 20 / 21), "Event Spike Anomalies": (1, 1 / 21)}


def test_timeline_lowest_ids_all_types(spark):
    ev = spark.createDataFrame([(1, 5, T0, "click"), (2, 5, T0 + dt.timedelta(hours=1), "view"),
                                (3, 9, T0, "click"), (4, 2, T0, "click")], SCHEMA)
    spikes = spark.createDataFrame([(9, 3), (5, 3), (7, 3)], "user_id long, event_count long")
    got = [(r.user_id, r.event_type) for r in suspicious_timeline(ev, spikes, n_users=2).collect()]
    assert got == [(5, "click"), (5, "view")]
    by_count = spark.createDataFrame([(9, 5), (5, 3), (2, 4)], "user_id long, event_count long")
    got = [r.user_id for r in suspicious_timeline(ev, by_count, n_users=2, order="count").collect()]
    assert got == [2, 9]


def test_isolation_forest_flags_outliers_at_rate(spark):
    rng = np.random.default_rng(3)
    n = 1000
    x = rng.normal(0, 1, (n, 2))
    x[:5] = [[12, 12], [-11, 13], [14, -12], [13, 13], [-12, -12]]
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(x)],
                               "user_id long, f1 double, f2 double")
    out = isolation_forest(df, ["f1", "f2"], trees=50, sample=128, contamination=0.02, seed=1)
    flagged = {r.user_id for r in out.where("anomaly = -1").collect()}
    assert {0, 1, 2, 3, 4} <= flagged
    assert 10 <= len(flagged) <= 30
    # deterministic under a different partitioning
    again = isolation_forest(df.repartition(3), ["f1", "f2"], trees=50, sample=128, contamination=0.02, seed=1)
    assert {r.user_id for r in again.where("anomaly = -1").collect()} == flagged


def test_forest_walk_equals_a_loop(spark):
    """The column expression walks the node table as a plain loop does."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 2))
    rows = []
    for t in range(7):
        feat, thr, left, right, size = _grow(x[rng.choice(300, 40, replace=False)], rng, 6)
        rows += [(t, i, *v) for i, v in enumerate(zip(feat, thr, left, right, size))]
    nodes = spark.createDataFrame([tuple(int(v) if j != 3 else float(v) for j, v in enumerate(r)) for r in rows],
                                  "tree int, node int, feature int, threshold double, left int, right int, size int")
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "user_id long, a double, b double")
    got = {r.user_id: r.anomaly_score for r in score_forest(df, ["a", "b"], nodes, 64).collect()}
    by = {(r[0], r[1]): r[2:] for r in rows}
    for i, v in enumerate(x):
        total = 0.0
        for t in range(7):
            at, depth = 0, 0
            while by[t, at][0] >= 0:
                f, cut, low, high, _ = by[t, at]
                at, depth = low if v[f] < cut else high, depth + 1
            total += depth + float(_c([by[t, at][4]])[0])
        assert abs(got[i] - 2 ** (-total / 7 / float(_c([40])[0]))) < 1e-12


def test_scoring_runs_without_python(spark):
    import __spark_entry__ as E
    from conftest import SMOKE
    from sparkjourney.plans.anomaly import forest_rows
    nodes = spark.createDataFrame(forest_rows(), "tree int, node int, feature int, threshold double, left int, right int, size int")
    df = spark.range(10).selectExpr("id AS user_id", "double(id) AS a", "double(id) AS b", "double(id) AS c")
    plan = score_forest(df, ["a", "b", "c"], nodes, 256)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.split("Subqueries")[0] and "InPandas" not in plan
    assert E.queries()["rfm_isolation_forest"](spark, SMOKE).where("anomaly = -1").count() >= 1
