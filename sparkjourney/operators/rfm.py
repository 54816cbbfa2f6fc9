"""Recency / frequency / monetary profiles, churn labels and per-user features.

All of these are per-user grouped aggregates (partial aggregation before the
shuffle, so a heavy user costs one partial row per task) plus a global
reference time taken through a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkjourney import schema as S
from sparkjourney.functions.scalar import threshold_flag
from sparkjourney.functions.time import whole_days_between
from sparkjourney.operators.sessions import session_totals


def reference_time(events: DataFrame, ts: str = S.TS):
    """Global latest event time as a scalar-subquery column.

    Pass the raw event scan rather than a derived frame: the subquery then
    reads one column of the source (``max`` over a pruned scan) instead of
    re-running the derivation.
    """
    return events.select(F.max(ts)).scalar()


def _as_of(events: DataFrame, as_of, ts: str):
    from pyspark.sql import Column
    if as_of is None:
        return reference_time(events, ts)
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def rfm(events: DataFrame, session_col: str = S.SESSION, user: str = S.USER, ts: str = S.TS,
        amount: str = S.AMOUNT, as_of=None, grain: str = "user") -> DataFrame:
    """(user, recency, frequency, monetary), one row per user.

    ``grain='event'`` instead attaches the user's RFM to each of its events
    (a left equi-join on the user; on a hot user AQE's skew-join handling
    splits the event side, and a small RFM table is broadcast at run time).

    * recency: whole days from the user's last event to ``as_of`` (a
      timestamp, a column such as ``reference_time(raw_events)``, or by
      default the latest event time of ``events``);
    * frequency: distinct sessions;
    * monetary: sum of amounts, 0 when all are NULL.
    """
    ref = _as_of(events, as_of, ts)
    # sessionized input flags one event per session: counting flags avoids
    # the two-phase distinct aggregation
    freq = (F.count_if("is_session_start") if session_col == S.SESSION and "is_session_start" in events.columns
            else F.countDistinct(session_col))
    per_user = (events.where(F.col(user).isNotNull())
                .groupBy(user)
                .agg(F.max(ts).alias("_last"),
                     freq.alias("frequency"),
                     F.coalesce(F.sum(amount), F.lit(0.0)).alias("monetary"))
                .select(user, whole_days_between(F.col("_last"), ref).alias("recency"), "frequency", "monetary"))
    if grain == "user":
        return per_user
    if grain == "event":
        return events.join(per_user, user, "left")
    raise ValueError(f"grain must be 'user' or 'event', not {grain!r}")


def rfm_of_events(events: DataFrame, gap_seconds: float = 1800.0, user: str = S.USER, ts: str = S.TS,
                  as_of=None) -> DataFrame:
    """``rfm(sessionize(events))`` at user grain from ``session_totals``: one shuffle of the events."""
    ref = _as_of(events, as_of, ts)
    return (session_totals(events, gap_seconds, user=user, ts=ts)
            .select(user, whole_days_between(F.col("last_ts"), ref).alias("recency"), "frequency", "monetary"))


def recency(events: DataFrame, user: str = S.USER, ts: str = S.TS, as_of=None) -> DataFrame:
    """(user, recency) alone: one partial aggregate, no sessions and no shuffle of events."""
    ref = _as_of(events, as_of, ts)
    return (events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(user).agg(F.max(ts).alias("_last"))
            .select(user, whole_days_between(F.col("_last"), ref).alias("recency")))


def churn_label(rfm_df: DataFrame, days: int = 7, recency: str = "recency", name: str = "churn") -> DataFrame:
    """``churn = 1`` when recency >= ``days`` (NULL recency -> 0)."""
    return rfm_df.withColumn(name, threshold_flag(recency, days))


def churn_counts(labelled: DataFrame, label: str = "churn") -> DataFrame:
    """Users per churn class."""
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n_users"))


def user_features(sessions: DataFrame, user: str = S.USER, ts: str = S.TS, event: str = S.EVENT,
                  product: str = S.PRODUCT, amount: str = S.AMOUNT, purchase: str = S.PURCHASE,
                  as_of=None) -> DataFrame:
    """Model features per user from sessionized events.

    frequency (sessions), monetary, avg session duration (seconds, averaged
    over the user's sessions), event count, distinct product count, days
    since last purchase (NULL for users who never bought) and recency.

    One grouped pass over the sessionized events: each session is counted and
    its duration averaged once, through the event flagged
    ``is_session_start`` (no per-session pre-aggregation, no join).
    """
    ref = _as_of(sessions, as_of, ts)
    first = F.col("is_session_start")
    per_user = (sessions.groupBy(user)
                .agg(F.count_if(first).alias("frequency"),
                     F.coalesce(F.sum(amount), F.lit(0.0)).alias("monetary"),
                     F.avg(F.when(first, F.col("session_duration"))).alias("session_duration"),
                     F.count(F.lit(1)).alias("event_count"),
                     F.countDistinct(product).alias("product_count"),
                     F.max(ts).alias("_last"),
                     F.max(F.when(F.col(event) == F.lit(purchase), F.col(ts))).alias("_last_buy")))
    return _features(per_user, ref, user)


def features_of_events(events: DataFrame, gap_seconds: float = 1800.0, user: str = S.USER, ts: str = S.TS,
                       product: str = S.PRODUCT, as_of=None) -> DataFrame:
    """``user_features(sessionize(events))`` from ``session_totals``.

    The events are shuffled once; distinct products are counted in two steps
    (partial rows per (user, product), then per user) and joined at user grain.
    """
    ref = _as_of(events, as_of, ts)
    products = (events.where(F.col(user).isNotNull() & F.col(ts).isNotNull() & F.col(product).isNotNull())
                .select(user, product).distinct().groupBy(user).agg(F.count(F.lit(1)).alias("_products")))
    per_user = (session_totals(events, gap_seconds, user=user, ts=ts).join(products, user, "left")
                .withColumn("session_duration", F.col("session_seconds") / F.col("frequency"))
                .withColumn("product_count", F.coalesce("_products", F.lit(0).cast("bigint")))
                .withColumnsRenamed({"last_ts": "_last", "last_purchase_ts": "_last_buy"}))
    return _features(per_user, ref, user)


def _features(per_user: DataFrame, ref, user: str) -> DataFrame:
    return (per_user.withColumn("_ref", ref)
            .select(user, "frequency", "monetary", "session_duration", "event_count", "product_count",
                    whole_days_between(F.col("_last_buy"), F.col("_ref")).alias("days_since_last_purchase"),
                    whole_days_between(F.col("_last"), F.col("_ref")).alias("recency")))
