"""Classification metrics as aggregates: confusion grid, report, ROC points, AUC.

Counts come from conditional aggregates over (label, prediction), so every
metric is one scan with partial aggregation.  ROC needs running totals over
the distinct scores in score order; a window without ``partitionBy`` would
pull every distinct score into a single task, so it uses
``quantiles.running_totals``, a scan in ranges.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sparkjourney.functions.scalar import with_scalar
from sparkjourney.operators.quantiles import running_totals


def predict_at(df: DataFrame, prob: str = "probability", threshold: float = 0.5, name: str = "prediction") -> DataFrame:
    """``prediction = 1`` when the class-1 probability is >= threshold."""
    return df.withColumn(name, (F.col(prob) >= F.lit(threshold)).cast("int"))


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """(label, prediction, n) for the complete 2x2 grid, zeros included."""
    one = df.agg(*[F.count_if((F.col(label) == a) & (F.col(pred) == p)).alias(f"c{a}{p}")
                   for a in (0, 1) for p in (0, 1)])
    rows = F.array(*[F.struct(F.lit(a).alias(label), F.lit(p).alias(pred), F.col(f"c{a}{p}").alias("n"))
                     for a in (0, 1) for p in (0, 1)])
    return one.select(F.inline(rows))


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p, r):
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """(row, precision, recall, f1, support) for classes 0 and 1, accuracy,
    macro avg and weighted avg (a zero denominator gives 0.0)."""
    c = {f"c{a}{p}": F.count_if((F.col(label) == a) & (F.col(pred) == p)) for a in (0, 1) for p in (0, 1)}
    one = df.agg(*[v.alias(k) for k, v in c.items()])
    n0 = F.col("c00") + F.col("c01")
    n1 = F.col("c10") + F.col("c11")
    tot = n0 + n1
    p0, r0 = _safe_div(F.col("c00"), F.col("c00") + F.col("c10")), _safe_div(F.col("c00"), n0)
    p1, r1 = _safe_div(F.col("c11"), F.col("c11") + F.col("c01")), _safe_div(F.col("c11"), n1)
    f0, f1 = _f1(p0, r0), _f1(p1, r1)
    acc = _safe_div(F.col("c00") + F.col("c11"), tot)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f.cast("double").alias("f1"), s.cast("bigint").alias("support"))

    rows = F.array(
        row("0", p0, r0, f0, n0), row("1", p1, r1, f1, n1),
        row("accuracy", F.lit(None), F.lit(None), acc, tot),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        row("weighted avg", _safe_div(p0 * n0 + p1 * n1, tot), _safe_div(r0 * n0 + r1 * n1, tot),
            _safe_div(f0 * n0 + f1 * n1, tot), tot),
    )
    return one.select(F.inline(rows))


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg) per distinct score (partial aggregation before the shuffle)."""
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                F.count_if(F.col(label) == 0).alias("neg")))


def roc_points(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score (predict 1 when
    score >= threshold), plus the origin with threshold +infinity."""
    sc = score_counts(df, label, score).withColumn("_k", -F.col(score))
    cum = with_scalar(running_totals(sc, "_k", ["pos", "neg"], buckets), "_t",
                      sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    P, N = F.col("_t")["P"], F.col("_t")["N"]
    pts = cum.select(F.col(score).cast("double").alias("threshold"),
                     _safe_div(F.col("neg_cum"), N).alias("fpr"), _safe_div(F.col("pos_cum"), P).alias("tpr"))
    origin = sc.limit(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """One row ``auc``: probability that a random positive outscores a random
    negative, ties counting one half (the trapezoid area of the ROC curve)."""
    sc = score_counts(df, label, score)
    cum = running_totals(sc, score, ["neg"], buckets)
    below = F.col("neg_cum") - F.col("neg")
    one = cum.agg(F.sum(F.col("pos") * (below + F.lit(0.5) * F.col("neg"))).alias("u"),
                  F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return one.select(_safe_div(F.col("u"), F.col("P") * F.col("N")).alias("auc"))
