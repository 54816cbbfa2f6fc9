"""Stage funnel: first time per stage, progression flags, drop-off, time to convert.

One pass builds the user x stage matrix of first times: a grouped aggregate
with one conditional ``min`` per stage (the pivot, with its value list
given, so an absent stage becomes an all-NULL column instead of an error).  Partial
aggregation runs before the shuffle by user, so heavy users cost one partial
row per task.  Everything after that works on one row per user, and the
summaries are single-row aggregates unpivoted into one row per stage.

Progression is pairwise: stage i is reached when stage i and stage i-1 were
both seen and the first time of i is not earlier than the first time of i-1.
It is not cumulative, so a later stage can count more users than an earlier
one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sparkjourney import schema as S
from sparkjourney.functions.scalar import null_safe, pct
from sparkjourney.functions.time import minutes_between

ARROW = S.TRANSITION_ARROW


def stage_times(events: DataFrame, stages: Sequence[str], user: str = S.USER, event: str = S.EVENT,
                ts: str = S.TS) -> DataFrame:
    """(user, <stage>...) first time per stage, for users with any stage event.

    One conditional ``min`` per stage in a single grouped aggregate: the
    user x stage matrix in one shuffle (``pivot`` with a value list would
    aggregate by (user, stage) first and shuffle twice).  A stage with no
    events is an all-NULL column.
    """
    stages = list(stages)
    return (events.where(F.col(event).isin(stages) & F.col(user).isNotNull() & F.col(ts).isNotNull())
            .groupBy(user).agg(*[F.min(F.when(F.col(event) == F.lit(s), F.col(ts))).alias(s) for s in stages]))


def funnel_flags(times: DataFrame, stages: Sequence[str], user: str = S.USER) -> DataFrame:
    """(user, <stage> boolean...) pairwise progression flags."""
    stages = list(stages)
    flags = [F.col(stages[0]).isNotNull().alias(stages[0])]
    for prev, cur in zip(stages, stages[1:]):
        flags.append(null_safe(F.col(cur).isNotNull() & F.col(prev).isNotNull()
                               & (F.col(cur) >= F.col(prev))).alias(cur))
    return times.select(user, *flags)


def funnel_summary(flags: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(stage_index, stage, users_reached, pct_of_previous, pct_of_first).

    The percentages are the funnel chart's "percent previous / percent
    initial" labels, computed on the few-row stage table.
    """
    stages = list(stages)
    one = flags.agg(*[F.count_if(F.col(s)).alias(f"n{i}") for i, s in enumerate(stages)])
    rows = F.array(*[F.struct(F.lit(i).alias("stage_index"), F.lit(s).alias("stage"),
                              F.col(f"n{i}").alias("users_reached"),
                              F.col(f"n{i - 1}" if i else "n0").alias("_prev"),
                              F.col("n0").alias("_first"))
                     for i, s in enumerate(stages)])
    return one.select(F.inline(rows)).select(
        "stage_index", "stage", "users_reached",
        pct("users_reached", "_prev").alias("pct_of_previous"),
        pct("users_reached", "_first").alias("pct_of_first"))


def funnel_dropoff(flags: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(step, from_to, users_entered, reached_next, dropped_off, pct_conversion).

    Entered = users flagged at the stage; reached next = flagged at both the
    stage and the next one; conversion = reached / entered in percent
    (0 when nobody entered), rounded to 2 places.  All pairs in one pass.
    """
    stages = list(stages)
    aggs = []
    for i, (a, b) in enumerate(zip(stages, stages[1:])):
        aggs += [F.count_if(F.col(a)).alias(f"e{i}"), F.count_if(F.col(a) & F.col(b)).alias(f"r{i}")]
    one = flags.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(a + ARROW + b).alias("from_to"),
                              F.col(f"e{i}").alias("users_entered"), F.col(f"r{i}").alias("reached_next"))
                     for i, (a, b) in enumerate(zip(stages, stages[1:]))])
    return one.select(F.inline(rows)).select(
        "step", "from_to", "users_entered", "reached_next",
        (F.col("users_entered") - F.col("reached_next")).alias("dropped_off"),
        pct("reached_next", "users_entered").alias("pct_conversion"))


def transition_minutes(times: DataFrame, stages: Sequence[str], user: str = S.USER) -> DataFrame:
    """(user, d0, d1, ...) minutes from stage i-1 to stage i first times."""
    stages = list(stages)
    return times.select(user, *[minutes_between(F.col(a), F.col(b)).alias(f"d{i}")
                                for i, (a, b) in enumerate(zip(stages, stages[1:]))])


def time_to_convert(times: DataFrame, stages: Sequence[str], user: str = S.USER, places: int = 2) -> DataFrame:
    """(step, transition, avg_hours) over users whose every gap exists and is >= 0.

    A user with any missing or negative gap is left out of every average
    (the filters are applied jointly, as in the analysis).
    """
    stages = list(stages)
    n = len(stages) - 1
    d = transition_minutes(times, stages, user)
    ok = F.lit(True)
    for i in range(n):
        ok = ok & null_safe(F.col(f"d{i}") >= 0)
    one = d.where(ok).agg(*[F.avg(f"d{i}").alias(f"a{i}") for i in range(n)])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(a + ARROW + b).alias("transition"),
                              F.round(F.col(f"a{i}") / F.lit(60.0), places).alias("avg_hours"))
                     for i, (a, b) in enumerate(zip(stages, stages[1:]))])
    return one.select(F.inline(rows))


def time_to_convert_by(times: DataFrame, groups: DataFrame, stages: Sequence[str], group_col: str = "cluster",
                       user: str = S.USER, places: int = 2) -> DataFrame:
    """(group, step, transition, avg_hours): per group, each transition averaged
    over its own non-negative gaps (filters are independent here)."""
    stages = list(stages)
    n = len(stages) - 1
    d = transition_minutes(times, stages, user).join(groups.select(user, group_col), user, "inner")
    one = d.groupBy(group_col).agg(*[F.avg(F.when(F.col(f"d{i}") >= 0, F.col(f"d{i}"))).alias(f"a{i}")
                                     for i in range(n)])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(a + ARROW + b).alias("transition"),
                              F.round(F.col(f"a{i}") / F.lit(60.0), places).alias("avg_hours"))
                     for i, (a, b) in enumerate(zip(stages, stages[1:]))])
    return one.select(group_col, F.inline(rows))


def funnel_by(flags: DataFrame, groups: DataFrame, stages: Sequence[str], group_col: str = "cluster",
              user: str = S.USER) -> DataFrame:
    """(group, <stage> users reached...) -- the per-segment funnel table."""
    stages = list(stages)
    return (flags.join(groups.select(user, group_col), user, "inner")
            .groupBy(group_col).agg(*[F.count_if(F.col(s)).alias(s) for s in stages]))


def transitions_wide(long: DataFrame, stages: Sequence[str], group_col: str = "cluster", value: str = "avg_hours") -> DataFrame:
    """(group, "<a> → <b>"...): the per-group transition table in wide form, one
    column per step of ``stages`` (NULL where a group has none); one grouped aggregate."""
    labels = [a + ARROW + b for a, b in zip(stages, stages[1:])]
    return long.groupBy(group_col).pivot("transition", labels).agg(F.first(value))


def transitions_long(wide: DataFrame, stages: Sequence[str], group_col: str = "cluster", value: str = "avg_hours") -> DataFrame:
    """(group, step, transition, value): ``transitions_wide`` undone, an unpivot of its columns."""
    labels = [a + ARROW + b for a, b in zip(stages, stages[1:])]
    step = F.array_position(F.array(*map(F.lit, labels)), F.col("transition")) - 1
    return (wide.unpivot([group_col], [f"`{x}`" for x in labels], "transition", value)
            .select(group_col, step.cast("int").alias("step"), "transition", value))
