"""Order statistics and running totals without one task holding a whole group.

Values are cut into ranges at approximate quantiles: a sketch of at most
``buckets`` numbers a group, broadcast while the groups are few (their number is
checked).  A value's range is found in two steps of about sqrt(buckets)
comparisons.

* ``select_ranks`` (selection, no sort): rows are counted per range, which is a
  partial aggregate; only the ranges that hold a wanted rank are then read
  again, their duplicates collapse, and what is left of them is put in order.
  Rows outside these ranges are never shuffled.
* ``running_totals`` (a distributed scan): each range is summed in its own task
  and starts from a table of range totals.

``percentile`` would hold a map of distinct value -> count per group instead, and
a window over the group all its rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from sparkjourney.functions.scalar import with_scalar
from sparkjourney.session import materialize

#: Tables of up to so many numbers are broadcast.
BROADCAST_NUMBERS = 2_000_000


def default_buckets(df: DataFrame) -> int:
    """Ranges a group is cut into: four a task, but for bounds that the sketch's accuracy sets."""
    return min(2048, max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def few(df: DataFrame, numbers_a_row: int) -> DataFrame:
    """The table, marked for broadcast if its rows are few enough (they are counted)."""
    df = materialize(df)
    return F.broadcast(df) if df.count() * numbers_a_row <= BROADCAST_NUMBERS else df


def _join(df: DataFrame, table: DataFrame, groups: list) -> DataFrame:
    """Inner join on the groups, of which NULL is one."""
    keys = {g: f"_g_{i}" for i, g in enumerate(groups)}
    table = table.select(*[F.col(g).alias(k) for g, k in keys.items()], *[c for c in table.columns if c not in groups])
    on = F.lit(True)
    for g, k in keys.items():
        on = on & F.col(g).eqNullSafe(F.col(k))
    return df.join(table, on, "inner").drop(*keys.values())


def cut_points(df: DataFrame, groups: Sequence[str], key, buckets: int) -> DataFrame:
    """(groups..., _coarse, _cuts): ascending cut points, and every ``step``-th of them."""
    step = math.isqrt(buckets)
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = df.groupBy(*groups).agg(F.array_distinct(F.percentile_approx(key, probs, 10000)).alias("_cuts"))
    return few(cuts.withColumn("_coarse", F.filter("_cuts", lambda c, i: i % step == step - 1)), buckets)


def in_ranges(df: DataFrame, groups: Sequence[str], cuts: DataFrame, key, buckets: int) -> DataFrame:
    """Add ``_rb``, the number of cut points below the key."""
    step = math.isqrt(buckets)
    below = F.size(F.filter("_coarse", lambda c: c < F.col("_key"))) * step
    fine = F.size(F.filter(F.slice("_cuts", F.col("_below") + 1, step), lambda c: c < F.col("_key")))
    if groups:
        x = _join(df, cuts, list(groups))
    else:  # one row
        x = with_scalar(df, "_one", cuts).withColumns({c: F.col("_one")[c] for c in cuts.columns}).drop("_one")
    return (x.withColumn("_key", key).withColumn("_below", below)
            .withColumn("_rb", F.col("_below") + fine).drop("_key", "_below", "_coarse", "_cuts"))


def running_totals(df: DataFrame, order_col: str, cols: Sequence[str], buckets: int | None = None, suffix: str = "_cum",
                   groups: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``cols`` in ascending ``order_col`` within each
    group (``order_col`` unique per group: aggregate to distinct keys first)."""
    groups, cols = list(groups), list(cols)
    buckets = buckets or default_buckets(df)
    key = F.col(order_col).cast("double")
    x = in_ranges(df, groups, cut_points(df, groups, key, buckets), key, buckets)
    w = W.partitionBy(*groups, "_rb").orderBy(order_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = x.select("*", *[F.sum(c).over(w).alias(f"_l_{c}") for c in cols])
    tot = x.groupBy(*groups, "_rb").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_rb").rowsBetween(W.unboundedPreceding, -1)
    off = tot.select(*groups, "_rb", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols])
    out = _join(local, few(off, len(cols) + 1), [*groups, "_rb"])
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(c + suffix) for c in cols])


def grouped_running_totals(df: DataFrame, groups: Sequence[str], order_col: str, cols: Sequence[str],
                           buckets: int | None = None, suffix: str = "_cum") -> DataFrame:
    return running_totals(df, order_col, cols, buckets, suffix, groups)


def select_ranks(df: DataFrame, value: str, ranks: Sequence, groups: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """(groups..., n, rank, value): the value at each 0-based rank in ascending order,
    of the n rows with a value.  ``ranks`` are column expressions of ``n``; ranks
    outside 0..n-1 and NULL ones give no row.  ``df`` is read three times."""
    groups = list(groups)
    buckets = buckets or default_buckets(df)
    df = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    key = F.col("_v").cast("double")
    x = in_ranges(df, groups, cut_points(df, groups, key, buckets), key, buckets)
    counts = x.groupBy(*groups, "_rb").agg(F.count(F.lit(1)).alias("_c"))
    by = W.partitionBy(*(groups or [F.lit(0)]))  # one row a range
    counts = (counts.withColumn("_before", F.sum("_c").over(by.orderBy("_rb")) - F.col("_c"))
              .withColumn("n", F.sum("_c").over(by)))
    wanted = F.array_distinct(F.filter(F.array(*[r.cast("bigint") for r in ranks]), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c"))))
    held = few(counts.withColumn("_ranks", wanted).where(F.size("_ranks") > 0).select(*groups, "_rb", "_before", "n", "_ranks"), len(ranks) + 3)
    values = _join(x, held, [*groups, "_rb"]).groupBy(*groups, "_rb", "n", "_before", "_ranks", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(W.partitionBy(*groups, "_rb").orderBy("_v"))
    values = values.withColumn("_upto", upto)
    hit = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")))
    return values.select(*groups, "n", F.explode(hit).alias("rank"), F.col("_v").alias("value"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (),
                    buckets: int | None = None) -> DataFrame:
    """(groups..., q, quantile): linear-interpolation quantiles, NULLs ignored."""
    groups = list(groups)
    at = [(F.col("n") - 1) * F.lit(float(q)) for q in probs]
    found = select_ranks(df.withColumn("_x", F.col(value).cast("double")), "_x",
                         [r for h in at for r in (F.floor(h), F.ceil(h))], groups, buckets)
    qs = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), h.alias("h")) for q, h in zip(probs, at)]))
    each = found.select(*groups, "rank", "value", qs.alias("_q")).select(*groups, "rank", "value", "_q.*")
    low, high = F.col("rank") == F.floor("h"), F.col("rank") == F.ceil("h")
    picked = each.where(low | high).groupBy(*groups, "q", "h").agg(
        F.max(F.when(low, F.col("value"))).alias("_v0"), F.max(F.when(high, F.col("value"))).alias("_v1"))
    return picked.select(*groups, "q", (F.col("_v0") + (F.col("h") - F.floor("h")) * (F.col("_v1") - F.col("_v0"))).alias("quantile"))
