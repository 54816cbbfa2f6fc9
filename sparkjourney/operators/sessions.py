"""Sessionization and per-event features (the preprocessing stage).

Semantics (per user, events ordered by time then ``event_id``):

* ``gap_seconds``: seconds since the user's previous event, 0 for the first.
* a new session starts when ``gap_seconds > gap`` (strictly: an event exactly
  ``gap`` seconds after the previous one stays in the session);
* ``session_id``: 0-based running count of session starts per user;
* ``session_duration``: last minus first event time of the session, seconds.

Scale design.  Users are the unit of work: one exchange of the events by user,
one sort, and windows over it.  A user too large for one task (more events than
``min_events`` and than twice the even share of a task) is cut into slices of
consecutive events:

1. a sample of bounded size (``SAMPLED`` rows a range) finds such users and the
   (time, event) points at which to cut them; all other users are left whole;
2. the events move once, by (user, slice), and are windowed there;
3. what a slice needs to know of its neighbours comes from cells: no session
   breaks within ``gap`` seconds, so (user, slice, time cell of that width) with its
   first and last time is all that the large users' sessions depend on.  Cells are
   partial aggregates, so this moves a few rows per task and cell, not events;
   one row per slice (at most ``ranges`` slices) is broadcast to the events.

The result is that of the plain per-user window, whatever the cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sparkjourney import schema as S
from sparkjourney.functions.time import seconds_between, epoch_seconds, weekday_mon0
from sparkjourney.session import materialize

_B = "_bucket"
_S = "_slice"
#: Rows sampled per range to find the users to cut and where.
SAMPLED = 64
#: A user with fewer events is never cut.
MIN_EVENTS = 1_000_000


def large_users(events: DataFrame, ranges: int, min_events: int, user: str = S.USER, ts: str = S.TS,
                order: str = S.EVENT_ID) -> DataFrame | None:
    """(user, cuts) of the users to be cut, or None: at most ``ranges`` cuts in
    all, each a (time, event) with which a new slice begins."""
    e = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(user, ts, order)
    rows = e.count()
    most = max(min_events, 2 * rows // ranges)
    if rows <= most:
        return None
    step = max(1, rows // (ranges * SAMPLED))  # one row in so many
    sample = e.where(F.pmod(F.xxhash64(user, ts, order), F.lit(step)) == 0)
    point = F.struct(F.col(ts).alias("t"), F.col(order).alias("o"))
    every = max(1, most // step)  # sampled rows a slice
    large = (sample.groupBy(user).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(point)).alias("_p"))
             .where(F.col("_n") * step > most)
             .select(user, F.filter("_p", lambda p, i: i % every == every - 1).alias("_cuts")))
    large = materialize(large)
    return None if large.isEmpty() else large


def _sliced(events: DataFrame, large: DataFrame, user: str, ts: str, order: str, how: str) -> DataFrame:
    here = F.struct(F.col(ts).alias("t"), F.col(order).alias("o"))
    piece = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c <= here)))
    return events.join(F.broadcast(large), user, how).withColumn(_S, piece).drop("_cuts")


def slice_states(events: DataFrame, large: DataFrame, gap_seconds: float, user: str = S.USER, ts: str = S.TS,
                 order: str = S.EVENT_ID) -> DataFrame:
    """One row per (large user, slice): the gap into it, the session it begins
    with, that session's start, the starts inside and the end of its last session."""
    gap = F.lit(float(gap_seconds))
    e = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(user, ts, order)
    width = F.lit(max(1, int(gap_seconds * 1e6)))  # two times in one cell differ by less: no break between them
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    cells = (_sliced(e, large, user, ts, order, "inner")
             .groupBy(user, _S, (us - F.pmod(us, width)).alias("_cell")).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")))
    wu = W.partitionBy(user).orderBy(_S, "_cell")
    cells = (cells.withColumn("_entry", seconds_between(F.lag("_hi").over(wu), F.col("_lo")))
             .withColumn("_sid", F.sum(F.coalesce((F.col("_entry") > gap).cast("int"), F.lit(0))).over(
                 wu.rowsBetween(W.unboundedPreceding, W.currentRow))))
    ws = W.partitionBy(user, "_sid")
    cells = cells.withColumn("_from", F.min("_lo").over(ws)).withColumn("_to", F.max("_hi").over(ws))
    first = F.min(F.struct("_cell", "_entry", "_from"))
    return cells.groupBy(user, _S).agg(
        F.min("_sid").alias("_offset"), (F.max("_sid") - F.min("_sid")).alias("_inside"),
        first["_entry"].alias("_entry"), first["_from"].alias("_from"), F.max("_to").alias("_to"))


def sessionize(events: DataFrame, gap_seconds: float = 1800.0, ranges: int | None = None, min_events: int = MIN_EVENTS,
               user: str = S.USER, ts: str = S.TS, order: str = S.EVENT_ID) -> DataFrame:
    """Add ``gap_seconds, gap_hours, session_id, is_session_start,
    session_start, session_end, session_duration`` to every event with a
    non-NULL user and time (exactly one event per session has
    ``is_session_start``).  ``ranges`` (default: the shuffle partitions) and
    ``min_events`` say which users are cut, not what comes out."""
    gap = F.lit(float(gap_seconds))
    e = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
    ranges = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = large_users(events, ranges, min_events, user, ts, order)
    by = [user] if large is None else [user, _S]
    if large is not None:
        e = _sliced(e, large, user, ts, order, "left")
    wb = W.partitionBy(*by).orderBy(ts, order)
    e = (e.withColumn("_gap", seconds_between(F.lag(ts).over(wb), F.col(ts)))
         .withColumn("_start", F.coalesce((F.col("_gap") > gap).cast("int"), F.lit(0)))
         .withColumn("_lsid", F.sum("_start").over(wb.rowsBetween(W.unboundedPreceding, W.currentRow))))
    ws = W.partitionBy(*by, "_lsid")
    e = e.withColumn("_lo", F.min(ts).over(ws)).withColumn("_hi", F.max(ts).over(ws))
    start, end, session, into, opens = F.col("_lo"), F.col("_hi"), F.col("_lsid"), F.lit(0.0), F.lit(True)
    if large is not None:
        e = e.join(F.broadcast(slice_states(events, large, gap_seconds, user, ts, order)), by, "left")
        start = F.when(F.col("_lsid") == 0, F.coalesce("_from", "_lo")).otherwise(start)
        end = F.when(F.col("_lsid") == F.coalesce("_inside", F.lit(-1)), F.col("_to")).otherwise(end)
        session = session + F.coalesce("_offset", F.lit(0))
        into = F.coalesce("_entry", F.lit(0.0))
        opens = F.coalesce(F.col("_entry") > gap, F.lit(True))
    gap_s = F.coalesce(F.col("_gap"), into)
    produced = {"gap_seconds", "gap_hours", S.SESSION, "is_session_start", "session_start", "session_end",
                "session_duration"}
    keep = [c for c in events.columns if c not in produced]  # re-sessionizing replaces these
    return e.select(
        *keep,
        gap_s.alias("gap_seconds"),
        (gap_s / F.lit(3600.0)).alias("gap_hours"),
        session.cast("bigint").alias(S.SESSION),
        ((F.col("_start") == 1) | (F.col("_gap").isNull() & opens)).alias("is_session_start"),
        start.alias("session_start"),
        end.alias("session_end"),
        seconds_between(start, end).alias("session_duration"),
    )


def session_totals(events: DataFrame, gap_seconds: float = 1800.0, bucket_seconds: int = 3600, user: str = S.USER,
                   ts: str = S.TS, event: str = S.EVENT, amount: str = S.AMOUNT, purchase: str = S.PURCHASE) -> DataFrame:
    """What a user's sessions add up to, without forming them: (user, frequency,
    session_seconds, event_count, monetary, last_ts, last_purchase_ts).

    A user has one session more than gaps over the limit, and the durations of
    its sessions add up to its gaps within the limit.  Both are sums over gaps,
    so the events are shuffled once by (user, bucket), where all inner gaps and
    the bucket's totals are found; the gap into a bucket is a lag over the
    user's bucket rows.  No per-event state is carried and nothing joins back.
    """
    gap = F.lit(float(gap_seconds))
    e = (events.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
         .withColumn(_B, F.floor(epoch_seconds(ts) / F.lit(int(bucket_seconds)))))
    e = e.withColumn("_gap", seconds_between(F.lag(ts).over(W.partitionBy(user, _B).orderBy(ts)), F.col(ts)))
    b = e.groupBy(user, _B).agg(
        F.min(ts).alias("_bmin"), F.max(ts).alias("_bmax"), F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("_gap") > gap).alias("_starts"),
        F.sum(F.when(F.col("_gap") <= gap, F.col("_gap"))).alias("_inside"),
        F.sum(amount).alias("_amount"),
        F.max(F.when(F.col(event) == F.lit(purchase), F.col(ts))).alias("_buy"))
    b = b.withColumn("_entry", seconds_between(F.lag("_bmax").over(W.partitionBy(user).orderBy(_B)), F.col("_bmin")))
    inside = F.coalesce("_inside", F.lit(0.0)) + F.when(F.col("_entry") <= gap, F.col("_entry")).otherwise(F.lit(0.0))
    return b.groupBy(user).agg(
        (F.sum("_starts") + F.count_if(F.col("_entry") > gap) + F.lit(1)).alias("frequency"),
        F.sum(inside).alias("session_seconds"), F.sum("_n").alias("event_count"),
        F.coalesce(F.sum("_amount"), F.lit(0.0)).alias("monetary"),
        F.max("_bmax").alias("last_ts"), F.max("_buy").alias("last_purchase_ts"))


def session_stats(sessions: DataFrame, user: str = S.USER, ts: str = S.TS) -> DataFrame:
    """One row per (user, session): start, end, duration in seconds, event count.

    Plain grouped aggregate: partial aggregation runs before the shuffle, so a
    session of any size only sends one partial row per task.
    """
    return (sessions.groupBy(user, S.SESSION)
            .agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
                 F.count(F.lit(1)).alias("n_events"))
            .withColumn("session_duration", seconds_between("session_start", "session_end")))


def event_features(events: DataFrame, ts: str = S.TS, event: str = S.EVENT,
                   purchase: str = S.PURCHASE) -> DataFrame:
    """Weekday (Monday = 0), hour of day and a purchase flag (NULL type -> 0)."""
    return (events.withColumn("weekday", weekday_mon0(ts))
            .withColumn("hour_of_day", F.hour(ts).cast("int"))
            .withColumn("made_purchase", F.coalesce((F.col(event) == F.lit(purchase)).cast("int"), F.lit(0))))


def preprocess(events: DataFrame, gap_seconds: float = 1800.0, scale_cols=(), **cut) -> DataFrame:
    """Sessionize + per-event features (+ z-scores of ``scale_cols`` as ``<c>_z``).

    Raw values are kept; standardized values go to new columns so later
    stages never read a z-score as if it were seconds or days.  With
    ``scale_cols`` the stage is written once (``materialize``); the sums for the
    z-scores and the z-scores themselves read the written rows.
    """
    from sparkjourney.operators.stats import standardize

    out = event_features(sessionize(events, gap_seconds=gap_seconds, **cut))
    if scale_cols:
        out = standardize(out, list(scale_cols), fit="written")
    return out
