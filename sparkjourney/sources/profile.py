"""Inspection: shape, dtypes, sample rows and per-column null counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def profile(df: DataFrame, sample: int = 3) -> dict:
    """Shape, column list, dtypes and a few sample rows (one count job)."""
    return {
        "rows": df.count(),
        "columns": df.columns,
        "dtypes": df.dtypes,
        "sample": [r.asDict() for r in df.limit(sample).collect()],
    }


def table_profile(df: DataFrame) -> DataFrame:
    """(position, column, type, rows, nulls, distinct_values): shape and types of a table, one row a column.

    Rows and nulls are one aggregate; distinct values are counted exactly, through
    (column, value hash) rows that are combined in each task before they move."""
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    facts = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), F.col(f"n{i}").alias("nulls"))
                      for i, (c, t) in enumerate(df.dtypes)])
    hashes = F.array(*[F.struct(F.lit(i).alias("position"), F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(1), c)).alias("h"), F.xxhash64(F.lit(2), c).alias("k")) for i, c in enumerate(cols)])
    values = df.select(F.inline(hashes)).where(F.col("h").isNotNull()).distinct().groupBy("position").agg(F.count(F.lit(1)).alias("distinct_values"))
    return (counts.select(F.inline(facts)).join(values, "position", "left")
            .withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("bigint"))))


def null_profile(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """(column, null_count) for every column, in one aggregation pass.

    All counts come from a single ``agg`` (partial aggregation per task, one
    row out), then ``unpivot`` turns the row into one row per column.
    """
    cols = df.columns
    one_row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    out = one_row.unpivot([], cols, "column", "null_count")
    if only_positive:
        out = out.where(F.col("null_count") > 0)
    return out
