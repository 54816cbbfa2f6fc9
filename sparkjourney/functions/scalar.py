"""Scalar column helpers: thresholds, regex flags, guarded percentages, relabels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_safe(pred: Column) -> Column:
    """A predicate where NULL means False (pandas comparison semantics)."""
    return F.coalesce(pred, F.lit(False))


def threshold_flag(c, k, strict: bool = False) -> Column:
    """``1`` if ``c >= k`` (``>`` when strict) else ``0``; NULL input -> 0."""
    pred = _col(c) > F.lit(k) if strict else _col(c) >= F.lit(k)
    return null_safe(pred).cast("int")


def regex_flag(c, pattern: str, case_insensitive: bool = True) -> Column:
    """``1`` when the string matches ``pattern`` anywhere, else 0 (NULL -> 0)."""
    p = ("(?i)" + pattern) if case_insensitive else pattern
    return null_safe(_col(c).rlike(p)).cast("int")


def pct(num, den, places: int | None = 2) -> Column:
    """``100 * num / den`` with a zero/NULL denominator giving 0.0."""
    v = F.when(_col(den) > 0, F.lit(100.0) * _col(num) / _col(den)).otherwise(F.lit(0.0))
    return F.round(v, places) if places is not None else v


def relabel(c, mapping: Mapping, default=None) -> Column:
    """Map values through a small literal dictionary; unmapped -> ``default``."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(_col(c) == F.lit(k), F.lit(v)) if expr is None
                else expr.when(_col(c) == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def lookup(c, mapping: Mapping) -> Column:
    """Dictionary lookup as a literal map (``create_map(...)[c]``); unmapped -> NULL."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)[_col(c)]


def with_scalar(df, name: str, one_row):
    """Attach a one-row aggregate to every row as a single struct column.

    ``one_row`` is a DataFrame with exactly one row (a global aggregate).  It
    becomes one uncorrelated scalar subquery, evaluated once and shipped to
    the tasks as a value (no join, no collect).  Read fields with
    ``F.col(name)[field]`` and drop the column when done; referencing the
    subquery once keeps the plan small however many expressions use it.
    """
    from pyspark.sql import functions as F
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns)).scalar())


def fit_row(one_row):
    """Fetch a fitted parameter row (a global aggregate: exactly one row of a
    fixed number of values), as Spark ML estimators do in ``fit``.

    Used where the parameters feed many expressions that are later grouped
    on: literals keep such plans small, whereas a scalar subquery would be
    copied into every reference by the optimizer.
    """
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one parameter row, got {len(rows)}")
    return rows[0]
