import datetime as dt

from sparkjourney.operators.funnel import (
    stage_times, funnel_flags, funnel_summary, funnel_dropoff, time_to_convert, time_to_convert_by, funnel_by,
    transitions_long, transitions_wide,
)

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, event_type string"
T0 = dt.datetime(2024, 1, 1)
ST = ["a", "b", "c"]


def _ev(spark, rows):
    return spark.createDataFrame([(i, u, T0 + dt.timedelta(hours=h), e) for i, (u, h, e) in enumerate(rows)], SCHEMA)


def _flags(spark, rows, stages=ST):
    return {r.user_id: tuple(r[s] for s in stages) for r in funnel_flags(stage_times(_ev(spark, rows), stages), stages).collect()}


def test_order_equal_times_and_gaps(spark):
    got = _flags(spark, [
        (1, 2, "a"), (1, 1, "b"),                 # b before a -> b false
        (2, 1, "a"), (2, 1, "b"),                 # equal times -> true
        (3, 1, "a"), (3, 3, "c"),                 # b absent, c present -> c false
        (4, 1, "b"), (4, 2, "c"),                 # not cumulative: c true although a false
        (5, 1, "a"), (5, 0, "a"), (5, 2, "b"),    # first time per stage is what counts
    ])
    assert got == {1: (True, False, False), 2: (True, True, False), 3: (True, False, False),
                   4: (False, False, True), 5: (True, True, False)}


def test_absent_stage_is_all_false(spark):
    got = _flags(spark, [(1, 1, "a"), (1, 2, "b")], ["a", "b", "zzz"])
    assert got == {1: (True, True, False)}


def test_summary_and_dropoff_zero_entered(spark):
    fl = funnel_flags(stage_times(_ev(spark, [(1, 1, "a"), (2, 1, "a"), (2, 2, "b")]), ST), ST)
    s = {r.stage: (r.users_reached, r.pct_of_previous, r.pct_of_first) for r in funnel_summary(fl, ST).collect()}
    assert s == {"a": (2, 100.0, 100.0), "b": (1, 50.0, 50.0), "c": (0, 0.0, 0.0)}
    d = {r.step: (r.users_entered, r.reached_next, r.dropped_off, r.pct_conversion)
         for r in funnel_dropoff(fl, ST).collect()}
    assert d == {0: (2, 1, 1, 50.0), 1: (1, 0, 1, 0.0)}
    for r in funnel_dropoff(fl, ST).collect():
        assert r.reached_next <= r.users_entered


def test_time_to_convert_joint_vs_independent_filters(spark):
    # user 1: a->b +2h, b->c -1h (negative gap); user 2: +1h, +3h
    ev = _ev(spark, [(1, 0, "a"), (1, 2, "b"), (1, 1, "c"), (2, 0, "a"), (2, 1, "b"), (2, 4, "c")])
    times = stage_times(ev, ST)
    overall = {r.transition: r.avg_hours for r in time_to_convert(times, ST).collect()}
    assert overall == {"a → b": 1.0, "b → c": 3.0}  # user 1 left out entirely
    groups = ev.sparkSession.createDataFrame([(1, 0), (2, 0)], "user_id long, cluster int")
    per = {r.transition: r.avg_hours for r in time_to_convert_by(times, groups, ST).collect()}
    assert per == {"a → b": 1.5, "b → c": 3.0}  # user 1's a->b kept
    long = time_to_convert_by(times, groups, ST)
    wide = transitions_wide(long, ST)
    assert wide.first()["a → b"] == 1.5 and wide.first()["b → c"] == 3.0
    back = transitions_long(wide, ST)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.select(*back.columns).collect()))


def test_funnel_by_group(spark):
    ev = _ev(spark, [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "a")])
    fl = funnel_flags(stage_times(ev, ST), ST)
    groups = ev.sparkSession.createDataFrame([(1, 0), (2, 0), (3, 1)], "user_id long, cluster int")
    got = {r.cluster: (r.a, r.b, r.c) for r in funnel_by(fl, groups, ST).collect()}
    assert got == {0: (2, 1, 0), 1: (1, 0, 0)}
