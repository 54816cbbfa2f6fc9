"""Sessions and spike counters over an event stream.

``session_window(ts, gap)`` gives the same session membership as the batch
sessionizer: an event exactly ``gap`` after the previous one stays in the
session, a microsecond more opens a new one.  Session state lives in the
state store keyed by user and is dropped once the watermark passes the
session end, so it stays bounded by the open sessions.  Differences to the
batch form: the window end reported by Spark is last event + gap (we also
emit the last event time) and there is no per-user session ordinal.

Rows arrive with TIMESTAMP_NTZ times; Spark's event-time operators need
TIMESTAMP, so the time is reinterpreted in UTC first (no shift when the
session time zone is UTC).

Start the returned streams with a ``checkpointLocation`` on shared storage:
offsets and the session state live there, so a restarted query (or lost
executors) resume exactly where they stopped, e.g.
``stream_session_stats(ev).writeStream.outputMode("append")
.option("checkpointLocation", f"{shared}/sessions").format("parquet")
.start(f"{shared}/sessions_out")``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkjourney import schema as S
from sparkjourney.functions.time import seconds_between


def _event_time(ts: str):
    """The wall-clock time as an instant, whatever the session's time zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{ts}` AS TIMESTAMP_NTZ)))")


def stream_session_stats(events: DataFrame, gap_seconds: int = 1800, watermark: str = "2 hours",
                         user: str = S.USER, ts: str = S.TS) -> DataFrame:
    """(user, session_start, session_end, n_events, session_duration) per closed session.

    Sessions are merged inside each input partition before rows move, so a user
    with a third of all events sends its partial sessions, not its events."""
    events.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    e = events.withColumn("_et", _event_time(ts)).withWatermark("_et", watermark)
    g = (e.groupBy(F.col(user), F.session_window("_et", f"{int(gap_seconds)} seconds").alias("w"))
         .agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
              F.count(F.lit(1)).alias("n_events")))
    return g.select(user, "session_start", "session_end", "n_events",
                    seconds_between("session_start", "session_end").alias("session_duration"))


def stream_event_counts(events: DataFrame, types, window: str = "1 day", watermark: str = "2 hours",
                        user: str = S.USER, ts: str = S.TS, event: str = S.EVENT) -> DataFrame:
    """Per user and tumbling window: count of the watched event types (the
    streaming input of spike detection)."""
    e = (events.where(F.col(event).isin(list(types)))
         .withColumn("_et", _event_time(ts)).withWatermark("_et", watermark))
    return (e.groupBy(F.col(user), F.window("_et", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("event_count"))
            .select(user, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "event_count"))
