"""Distribution statistics: z-scores, describe, histogram, correlation, box figures.

Global statistics are one-row aggregates (partial aggregation in every task,
a single row out) used through scalar subqueries (``DataFrame.scalar()``):
Spark runs the subquery once and ships the value to the tasks, with no
cross join, and under AQE the subquery reuses the main plan's shuffles.

Exact percentiles come from ``operators.quantiles`` (selection by ranges),
never from a single task holding a whole column;
``exact=False`` uses the sketch-based ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sparkjourney.functions.scalar import with_scalar, fit_row
from sparkjourney.operators.quantiles import exact_quantiles, few
from sparkjourney.session import materialize

DESCRIBE_PROBS = (0.5, 0.75, 0.9, 0.95, 0.99)


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_z", population: bool = True,
                fit: str = "subquery") -> DataFrame:
    """Add ``<c><suffix> = (c - mean) / std`` for each column; zero variance -> 0.

    ``population=True`` divides by the population std (as the analysis'
    scaler does); Spark ML's ``StandardScaler`` divides by the sample std.

    ``fit='subquery'`` keeps the statistics in the plan (one pass shared with
    the upstream shuffles: right for large event-grain input used once);
    ``fit='row'`` fetches them as literals (right for a materialized,
    user-grain input that is later grouped on the z-scores, where a subquery
    would be copied into every reference);
    ``fit='written'`` materializes the input once; the statistics and the
    z-scores read the written rows (right for an expensive event-grain stage).
    """
    std = F.stddev_pop if population else F.stddev_samp
    if fit == "row":
        st = fit_row(df.agg(*[F.struct(F.avg(c).alias("m"), std(c).alias("s")).alias(c) for c in cols]))
        out = df
        for c in cols:
            m, s = st[c]["m"], st[c]["s"]
            z = (F.col(c) - F.lit(m)) / F.lit(s) if (s is not None and s > 0) else F.lit(0.0)
            out = out.withColumn(c + suffix, z.cast("double"))
        return out
    if fit == "written":
        df = materialize(df)
        return apply_scaler(df, scaler_stats(df, cols, population), cols, suffix)
    # one scalar subquery: Spark runs it once and, under AQE, it shares the
    # upstream shuffle with the main plan (a separate fit job would not)
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), std(c).alias("s")).alias(c) for c in cols])
    out = with_scalar(df, "_st", stats)
    for c in cols:
        m, s = F.col("_st")[c]["m"], F.col("_st")[c]["s"]
        out = out.withColumn(c + suffix, F.when(s > 0, (F.col(c) - m) / s).otherwise(F.lit(0.0)))
    return out.drop("_st")


def _pname(p: float) -> str:
    return f"p{int(round(p * 100))}"


def scaler_stats(df: DataFrame, cols: Sequence[str], population: bool = True) -> DataFrame:
    """One row: ``<c>_mean`` and ``<c>_std`` per column (a fitted scaler)."""
    std = F.stddev_pop if population else F.stddev_samp
    return df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), std(c).alias(f"{c}_std"))])


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add ``<c><suffix>`` from a ``scaler_stats`` row (zero std -> 0)."""
    st = fit_row(stats)
    out = df
    for c in cols:
        m, s = st[f"{c}_mean"], st[f"{c}_std"]
        z = (F.col(c) - F.lit(m)) / F.lit(s) if (s is not None and s > 0) else F.lit(0.0)
        out = out.withColumn(c + suffix, z.cast("double"))
    return out


def describe(df: DataFrame, col: str, probs: Sequence[float] = DESCRIBE_PROBS, exact: bool = True) -> DataFrame:
    """count, mean, std (n-1), min, requested percentiles (linear), max -- one row.

    ``exact=True`` takes the percentiles from the distributed order
    statistics of ``operators.quantiles`` (no task holds the whole column);
    ``exact=False`` from a ``percentile_approx`` sketch.
    """
    moments = df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                     F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"))
    if exact:
        qt = exact_quantiles(df, col, probs).agg(
            *[F.max(F.when(F.col("q") == F.lit(float(p)), F.col("quantile"))).alias(_pname(p)) for p in probs])
        out = with_scalar(moments, "_q", qt)
        pcols = [F.col("_q")[_pname(p)].alias(_pname(p)) for p in probs]
    else:
        sketch = F.percentile_approx(F.col(col), F.array(*[F.lit(p) for p in probs]), 100000)
        out = with_scalar(moments, "_q", df.agg(sketch.alias("p")))
        pcols = [F.col("_q")["p"][i].cast("double").alias(_pname(p)) for i, p in enumerate(probs)]
    return out.select("count", "mean", "std", "min", *pcols, "max")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max] with every bin present (empty -> 0).

    Bin ``i`` covers ``[min + i*w, min + (i+1)*w)``; the last bin also holds
    the maximum.  Output: bin, bin_start, bin_end, n.
    """
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = F.col("_r")["lo"], F.col("_r")["hi"]
    idx = F.when(hi > lo, F.least(F.floor((x - lo) * F.lit(float(bins)) / (hi - lo)), F.lit(bins - 1))) \
        .otherwise(F.lit(0)).cast("int")
    counts = (with_scalar(df.where(x.isNotNull()), "_r", rng)
              .groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    # the bin grid is generated from the one-row range table: `bins` rows
    grid = rng.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation matrix in long form: (row_feature, col_feature, corr).

    All pairs come from a single aggregation pass (k(k+1)/2 ``corr``
    aggregates over one scan); a constant column yields NULL/NaN.
    """
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    x = [F.col(c).cast("double") for c in cols]
    one = df.agg(*[F.corr(x[i], x[j]).alias(f"{i}_{j}") for i, j in pairs])
    rows = [F.struct(F.lit(a).alias("row_feature"), F.lit(b).alias("col_feature"),
                     F.col(f"`{min(i, j)}_{max(i, j)}`").alias("corr"))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def box_stats(df: DataFrame, label: str, cols: Sequence[str], whisker: float = 1.5,
              exact: bool = True) -> DataFrame:
    """Box-plot figures per label value and feature.

    q1/median/q3 (linear interpolation), whiskers at the most extreme values
    within ``whisker * IQR`` of the quartiles, and the count of points beyond.
    Long form: (label, feature, q1, median, q3, lower_whisker, upper_whisker,
    n_outliers).  Quartiles are selected by rank (``quantiles.select_ranks``);
    the whiskers come from a grouped aggregate after a join with the quartile
    table, which is broadcast while it is small.
    """
    cols = list(cols)
    long = df.select(F.col(label).alias("label"),
                     F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                                         for c in cols])).alias("kv")) \
        .select("label", "kv.feature", "kv.x").where(F.col("x").isNotNull())
    if exact:
        qs = exact_quantiles(long, "x", [0.25, 0.5, 0.75], ["label", "feature"])
        q = qs.groupBy("label", "feature").agg(
            *[F.max(F.when(F.col("q") == F.lit(v), F.col("quantile"))).alias(n)
              for v, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    else:
        probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        q = (long.groupBy("label", "feature").agg(F.percentile_approx("x", probs, 100000).alias("_q"))
             .select("label", "feature", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                     F.col("_q")[2].alias("q3")))
    fence = whisker * (F.col("q3") - F.col("q1"))
    j = long.join(few(q, 5), ["label", "feature"])
    inside_lo = F.col("x") >= F.col("q1") - fence
    inside_hi = F.col("x") <= F.col("q3") + fence
    return (j.groupBy("label", "feature", "q1", "median", "q3")
            .agg(F.min(F.when(inside_lo, F.col("x"))).alias("lower_whisker"),
                 F.max(F.when(inside_hi, F.col("x"))).alias("upper_whisker"),
                 F.count_if(~(inside_lo & inside_hi)).alias("n_outliers")))


def value_counts(df: DataFrame, col: str, name: str = "n", dropna: bool = True) -> DataFrame:
    """Count per value (NULL values dropped by default), largest first."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return src.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc(col))


def shares(counts: DataFrame, count_col: str = "n", name: str = "share", places: int | None = None) -> DataFrame:
    """Share of total on an already-aggregated (small) table: ``n / sum(n)``."""
    out = with_scalar(counts, "_t", counts.agg(F.sum(count_col).alias("t")))
    v = F.col(count_col) / F.col("_t")["t"]
    return out.withColumn(name, F.round(v, places) if places is not None else v).drop("_t")
