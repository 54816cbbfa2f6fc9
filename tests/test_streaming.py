"""Streaming sessions equal the batch sessionizer's sessions on the smoke events."""

import shutil
import tempfile

from pyspark.sql import functions as F

from conftest import SMOKE
from sparkjourney.operators.sessions import session_stats
from sparkjourney.plans import tables as t
from sparkjourney.sources.readers import bind_events
from sparkjourney.streaming import stream_session_stats, stream_event_counts


def _run(spark, df, name, mode="append"):
    ck = tempfile.mkdtemp(prefix="sj-stream-", dir="/tmp")
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(300)
    out = spark.table(name)
    return out


def _source_dir():
    """A stream source directory holding a copy of the smoke events file."""
    d = tempfile.mkdtemp(prefix="sj-src-", dir="/tmp")
    shutil.copy(f"{SMOKE}/events.parquet", f"{d}/part-0.parquet")
    return d


def test_stream_sessions_match_batch(spark):
    raw = spark.readStream.schema(spark.read.parquet(f"{SMOKE}/events.parquet").schema) \
        .option("maxFilesPerTrigger", 1).parquet(_source_dir())
    got = _run(spark, stream_session_stats(bind_events(raw), watermark="0 seconds"), "sj_sessions")
    want = session_stats(t.sessions(spark, SMOKE))
    key = ["user_id", "session_start", "session_end", "n_events"]
    # append mode emits a session once the watermark passes it: the sessions
    # still open at the end of the input are not emitted yet
    g = {tuple(r) for r in got.select(*key).collect()}
    w = {tuple(r) for r in want.select(*key).collect()}
    assert g and g <= w
    last = want.groupBy("user_id").agg(F.max("session_start").alias("s"))
    closed = want.join(last, "user_id").where(F.col("session_start") < F.col("s")).select(*key)
    assert {tuple(r) for r in closed.collect()} <= g


def test_stream_event_counts_total(spark):
    raw = spark.readStream.schema(spark.read.parquet(f"{SMOKE}/events.parquet").schema).parquet(_source_dir())
    got = _run(spark, stream_event_counts(bind_events(raw), ["click", "signup"], watermark="0 seconds"),
               "sj_counts", mode="update")
    total = got.groupBy("user_id", "window_start").agg(F.max("event_count").alias("n")).agg(F.sum("n")).first()[0]
    want = spark.read.parquet(f"{SMOKE}/events.parquet").where(F.col("event_type").isin("click", "signup")).count()
    assert total == want


def test_sessions_do_not_depend_on_the_time_zone(spark):
    from sparkjourney.streaming.sessions import stream_session_stats
    df = spark.sql("SELECT 1L AS user_id, t AS ts FROM VALUES (TIMESTAMP_NTZ'2024-03-10 01:50:00'), (TIMESTAMP_NTZ'2024-03-10 03:10:00') AS v(t)")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert stream_session_stats(df).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
