"""Sinks: stage outputs, per-cluster exports and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a full stage output (parquet by default, CSV with a header row)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_by_cluster(df: DataFrame, path: str, cluster_col: str = "cluster", fmt: str = "csv") -> None:
    """One output directory per cluster value in a single distributed write.

    ``partitionBy`` replaces a driver loop of filter+write per cluster, and a
    later read filtered on the cluster prunes the other directories.
    """
    write_stage(df, path, fmt=fmt, partition_by=[cluster_col])


def export_cluster(df: DataFrame, cluster, cluster_col: str = "cluster",
                   columns: list[str] | None = None) -> DataFrame:
    """Rows of one cluster with the export columns (filter + projection)."""
    out = df.where(F.col(cluster_col) == F.lit(cluster))
    return out.select(*columns) if columns else out


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model or pipeline (overwrites)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
