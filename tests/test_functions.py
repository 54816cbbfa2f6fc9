import datetime as dt

from pyspark.sql import functions as F

from sparkjourney.functions import (
    timestamp_from_parts, whole_days_between, seconds_between, threshold_flag, regex_flag, pct, lookup, relabel,
)


def test_timestamp_from_parts_bad_input_is_null(spark):
    df = spark.createDataFrame(
        [(2024, 1, 2, "05:07.5"), (2024, 13, 1, "05:07"), (2024, 1, 1, "66:07"), (None, 1, 1, "05:07"),
         (2024, 2, 30, "00:00")], "y int, m int, d int, t string")
    got = [r.ts for r in df.select(timestamp_from_parts("y", "m", "d", "t").alias("ts")).collect()]
    assert got[0] == dt.datetime(2024, 1, 2, 0, 5, 7, 500000)
    assert got[1:] == [None, None, None, None]


def test_whole_days_floor_and_seconds(spark):
    t = dt.datetime(2024, 1, 10)
    df = spark.createDataFrame([(t - dt.timedelta(days=6, hours=23), t), (t - dt.timedelta(days=7), t)],
                               "a timestamp_ntz, b timestamp_ntz")
    got = [(r.d, r.s) for r in df.select(whole_days_between("a", "b").alias("d"),
                                         seconds_between("a", "b").alias("s")).collect()]
    assert got == [(6, 601200.0), (7, 604800.0)]


def test_threshold_regex_pct_lookup(spark):
    df = spark.createDataFrame([(6, "WIN-BACK now", 0, 3), (7, None, 4, 1), (None, "Loyal", 2, 7)],
                               "r int, a string, e int, c int")
    got = df.select(threshold_flag("r", 7).alias("f"), regex_flag("a", "Win-Back|At-Risk").alias("g"),
                    pct("c", "e").alias("p"), lookup("c", {3: "x", 1: "y"}).alias("l"),
                    relabel("c", {3: "three"}, default="other").alias("rl")).collect()
    assert [(r.f, r.g, r.p, r.l, r.rl) for r in got] == [
        (0, 1, 0.0, "x", "three"), (1, 0, 25.0, "y", "other"), (0, 0, 350.0, None, "other")]
