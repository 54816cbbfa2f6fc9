import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkjourney.operators.sessions import large_users, sessionize, session_stats, slice_states, event_features

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string"
T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_gap_boundary_is_strict(spark):
    # gaps of 1799.9 s, 1800 s and 1800.000001 s: only the last opens a session
    t1 = T0 + dt.timedelta(seconds=1799.9)
    t2 = t1 + dt.timedelta(seconds=1800)
    t3 = t2 + dt.timedelta(seconds=1800, microseconds=1)
    out = sessionize(_df(spark, [(1, 7, T0, "a"), (2, 7, t1, "a"), (3, 7, t2, "a"), (4, 7, t3, "a")]))
    got = {r.event_id: (r.session_id, r.gap_seconds) for r in out.collect()}
    assert got[1] == (0, 0.0)
    assert got[2] == (0, 1799.9)
    assert got[3] == (0, 1800.0)
    assert got[4] == (1, 1800.000001)


def test_ties_in_time_are_stable(spark):
    out = sessionize(_df(spark, [(2, 1, T0, "a"), (1, 1, T0, "b")]))
    got = sorted((r.event_id, r.session_id, r.gap_seconds) for r in out.collect())
    assert got == [(1, 0, 0.0), (2, 0, 0.0)]


def test_null_time_and_user_dropped(spark):
    out = sessionize(_df(spark, [(1, 1, T0, "a"), (2, 1, None, "a"), (3, None, T0, "a")]))
    assert [r.event_id for r in out.collect()] == [1]


def test_session_duration_and_stats(spark):
    ev = [(1, 1, T0, "a"), (2, 1, T0 + dt.timedelta(minutes=10), "a"), (3, 1, T0 + dt.timedelta(hours=5), "a")]
    s = sessionize(_df(spark, ev))
    st = {r.session_id: (r.n_events, r.session_duration) for r in session_stats(s).collect()}
    assert st == {0: (2, 600.0), 1: (1, 0.0)}
    assert sorted(r.session_duration for r in s.collect()) == [0.0, 600.0, 600.0]


def _pandas_sessions(pdf, gap=1800.0):
    p = pdf.sort_values(["user_id", "ts", "event_id"]).copy()
    d = p.groupby("user_id")["ts"].diff().dt.total_seconds().fillna(0.0)
    p["gap_seconds"] = d
    p["session_id"] = (d > gap).astype(int).groupby(p["user_id"]).cumsum()
    g = p.groupby(["user_id", "session_id"])["ts"]
    p["session_duration"] = (g.transform("max") - g.transform("min")).dt.total_seconds()
    return p.set_index("event_id")[["gap_seconds", "session_id", "session_duration"]]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("ranges,gap", [(1, 1800.0), (3, 1800.0), (16, 1800.0), (16, 0.0), (150, 60.0)])
def test_cut_users_equal_per_user_window(spark, seed, ranges, gap):
    """Cutting users into slices must not change any result."""
    rng = np.random.default_rng(seed)
    n = 400
    users = rng.integers(0, 4, n)
    # bursts and long pauses so sessions cross bucket borders in every way
    steps = rng.choice([0.0, 5.0, 60.0, 1200.0, 1800.0, 1801.0, 4000.0, 90000.0], size=n, p=[.3, .1, .1, .1, .1, .1, .1, .1])
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(steps) + rng.integers(0, 3, n), unit="s")
    pdf = pd.DataFrame({"event_id": np.arange(n, dtype="int64"), "user_id": users.astype("int64"),
                        "ts": ts, "event_type": "x"})
    pdf.loc[100:140, "ts"] = pdf.loc[100, "ts"]  # many events at one time
    want = _pandas_sessions(pdf, gap)
    df = spark.createDataFrame(pdf, SCHEMA)
    assert (large_users(df, ranges, 1) is None) == (ranges < 8)
    got = sessionize(df, gap, ranges, 1).toPandas().set_index("event_id")
    got = got.loc[want.index]
    assert (got["session_id"].to_numpy() == want["session_id"].to_numpy()).all()
    assert np.allclose(got["gap_seconds"], want["gap_seconds"])
    assert np.allclose(got["session_duration"], want["session_duration"])
    starts = got.groupby(["user_id", "session_id"])["is_session_start"].sum()
    assert (starts == 1).all()
    spans = got.groupby(["user_id", "session_id"])
    assert (spans["session_start"].nunique() == 1).all() and (spans["session_end"].nunique() == 1).all()
    assert (got["session_start"] == spans["ts"].transform("min")).all() and (got["session_end"] == spans["ts"].transform("max")).all()


def test_a_hot_user_inside_one_hour_is_split(spark):
    """A third of all events is one user's, within one hour."""
    hot = spark.range(30_000).selectExpr("id AS event_id", "-1L AS user_id", "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id * 0.1) AS ts", "'a' AS event_type")
    rest = spark.range(60_000).selectExpr("100000 + id AS event_id", "id % 3000 AS user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 5) AS ts", "'a' AS event_type")
    ev = hot.union(rest)
    large = large_users(ev, 50, 100)
    assert [r.user_id for r in large.collect()] == [-1] and 5 < len(large.first()._cuts) <= 50
    out = sessionize(ev, ranges=50, min_events=100)
    assert tuple(out.where("user_id = -1").selectExpr("count(*)", "max(session_id)", "sum(int(is_session_start))", "max(session_duration)").first()) == (30000, 0, 1, 2999.9)
    assert slice_states(ev, large, 1800.0).count() == len(large.first()._cuts) + 1


def test_session_ids_start_at_zero_and_never_decrease(spark):
    s = sessionize(_df(spark, [(i, i % 3, T0 + dt.timedelta(minutes=47 * i), "a") for i in range(60)]))
    p = s.toPandas().sort_values(["user_id", "ts"])
    for _, g in p.groupby("user_id"):
        ids = g["session_id"].to_numpy()
        assert ids[0] == 0 and (np.diff(ids) >= 0).all() and (np.diff(ids) <= 1).all()
    assert len(p) == 60


def test_event_features(spark):
    mon = dt.datetime(2024, 1, 1, 13, 5)  # a Monday
    df = spark.createDataFrame([(1, 1, mon, "purchase"), (2, 1, mon + dt.timedelta(days=6), None)], SCHEMA)
    got = {r.event_id: (r.weekday, r.hour_of_day, r.made_purchase) for r in event_features(df).collect()}
    assert got == {1: (0, 13, 1), 2: (6, 13, 0)}


def test_shuffle_partitions_do_not_change_sessions(spark):
    from sparkjourney.plans import tables as t
    from conftest import SMOKE
    base = sorted(tuple(r) for r in t.sessions(spark, SMOKE).select("event_id", "session_id").collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        other = sorted(tuple(r) for r in t.sessions(spark, SMOKE).select("event_id", "session_id").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert base == other


def test_resessionizing_replaces_session_columns(spark):
    from sparkjourney.plans import tables as t
    from conftest import SMOKE
    once = t.sessions(spark, SMOKE)
    twice = sessionize(once)
    assert len(twice.columns) == len(set(twice.columns)) == len(once.columns)
    a = sorted(tuple(r) for r in once.select("event_id", "session_id").collect())
    b = sorted(tuple(r) for r in twice.select("event_id", "session_id").collect())
    assert a == b
