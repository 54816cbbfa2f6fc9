"""Customer segments: scaling, PCA, K-means sweep, assignment, profiles, actions.

The fits run on the per-user RFM table (one row per user, never per event).  PCA
comes from one aggregate of moments: a covariance matrix of d x d numbers is all
that reaches the driver, and the projection is a column expression.  K-means
advances all numbers of clusters and starts together (``operators.kmeans``).
Cluster ids from K-means are arbitrary, so they are
re-ranked deterministically (largest mean monetary first) before business
names are attached.  Assignment to known centres is a pure column expression
(squared distance to each centre, arg-min), so scoring needs no join and no
Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from sparkjourney import schema as S
from sparkjourney.functions.scalar import fit_row, lookup
from sparkjourney.operators.kmeans import kmeans_sweep
from sparkjourney.operators.stats import standardize
from sparkjourney.session import materialize

RFM_COLS = ("recency", "frequency", "monetary")

MARKETING_ACTIONS = S.MARKETING_ACTIONS
CHURN_ACTION_PATTERN = S.CHURN_ACTION_PATTERN


def nearest_centroid(df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]],
                     name: str = "cluster") -> DataFrame:
    """Assign each row to the nearest centre (squared Euclidean; lowest id on ties)."""
    cols = list(cols)
    cands = []
    for k, c in enumerate(centres):
        d2 = None
        for col, v in zip(cols, c):
            term = (F.col(col) - F.lit(float(v))) * (F.col(col) - F.lit(float(v)))
            d2 = term if d2 is None else d2 + term
        cands.append(F.struct(d2.alias("d2"), F.lit(k).alias("k")))
    best = F.array_min(F.array(*cands))
    return df.withColumn(name, best.getField("k")).withColumn("distance", F.sqrt(best.getField("d2")))


def cluster_profile(seg: DataFrame, cluster: str = "cluster", cols: Sequence[str] = RFM_COLS,
                    places: int | None = 2) -> DataFrame:
    """(cluster, n_users, mean of each measure rounded) -- every cluster."""
    def mean(c):
        return F.round(F.avg(c), places) if places is not None else F.avg(c)
    return seg.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_users"), *[mean(c).alias(f"avg_{c}") for c in cols])


def marketing_actions(seg: DataFrame, actions: dict = MARKETING_ACTIONS, cluster: str = "cluster",
                      cols: Sequence[str] = (S.USER,) + RFM_COLS) -> DataFrame:
    """Per user: RFM, cluster and action text (unmapped cluster -> NULL)."""
    return seg.select(*cols, cluster, lookup(cluster, actions).alias("marketing_action"))


def action_counts(actions: DataFrame, col: str = "marketing_action") -> DataFrame:
    """(marketing_action, customer_count); NULL actions dropped."""
    return (actions.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("customer_count")))


def rerank_clusters(seg: DataFrame, cluster: str = "prediction", by: str = "monetary",
                    name: str = "cluster") -> DataFrame:
    """Relabel arbitrary cluster ids 0..k-1 by descending mean of ``by``.

    The ranking runs on the k-row profile table (k is the model's cluster
    count, a fixed small bound), which is then joined back as a broadcast.
    """
    prof = seg.groupBy(cluster).agg(F.avg(by).alias("_m"))
    ranked = prof.select(cluster, (F.row_number().over(W.orderBy(F.desc("_m"), F.asc(cluster))) - 1)
                         .cast("int").alias(name))
    return seg.join(F.broadcast(ranked), cluster).drop(cluster)


class PCA(NamedTuple):
    """``components`` (one row each, largest variance first, the largest weight positive),
    the ``means`` taken off first, and each component's ``share`` of the variance."""
    components: np.ndarray
    means: np.ndarray
    share: np.ndarray


def fit_pca(df: DataFrame, cols: Sequence[str], k: int | None = None) -> PCA:
    """PCA from one aggregate: means, and covariances of each pair of columns."""
    x = [F.col(c).cast("double") for c in cols]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = fit_row(df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]))
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(x))] for i in range(len(x))], float)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    components = vectors.T[order]
    components = components * np.sign(components[np.arange(len(order)), np.abs(components).argmax(1)])[:, None]
    total = values.sum()
    share = np.maximum(values[order], 0) / total if total > 0 else np.zeros(len(order))
    return PCA(components, np.array([row[f"m{i}"] or 0.0 for i in range(len(x))]), share)


def project(df: DataFrame, cols: Sequence[str], pca: PCA, prefix: str = "pc") -> DataFrame:
    """Add ``pc1``, ``pc2``...: the columns in the components' directions."""
    def component(weights):
        out = F.lit(0.0)
        for c, m, w in zip(cols, pca.means, weights):
            out = out + (F.col(c).cast("double") - F.lit(float(m))) * F.lit(float(w))
        return out
    return df.withColumns({f"{prefix}{i + 1}": component(w) for i, w in enumerate(pca.components)})


def scaled_features(rfm_df: DataFrame, cols: Sequence[str] = RFM_COLS, pca_k: int | None = 3) -> tuple[PCA | None, DataFrame, list[str]]:
    """Standardize (population std), then PCA: (pca, frame, feature columns).
    Without ``pca_k`` the features are the z-scores."""
    # the scaler and the PCA fit both read it: what lies below runs once
    z = standardize(materialize(rfm_df), list(cols), fit="row")
    zc = [c + "_z" for c in cols]
    if not pca_k:
        return None, z, zc
    pca = fit_pca(z, zc, pca_k)
    return pca, project(z, zc, pca), [f"pc{i + 1}" for i in range(len(pca.components))]


def pca_variance(pca: PCA) -> list[tuple[int, float, float]]:
    """(component, explained variance ratio, cumulative ratio)."""
    return [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(pca.share, np.cumsum(pca.share)))]


def choose_k(sweep: DataFrame) -> DataFrame:
    """Best silhouette; the smallest k wins a tie."""
    return sweep.orderBy(F.desc("silhouette"), F.asc("k")).limit(1)


def segment(rfm_df: DataFrame, ks: Sequence[int] = range(2, 11), n_init: int = 10, pca_k: int = 3,
            seed: int = 42):
    """RFM -> scaled -> PCA -> K-means sweep -> best k -> re-ranked clusters.

    Returns (assignments(user, rfm..., cluster), sweep rows, chosen k).
    """
    _, feats, cols = scaled_features(rfm_df, RFM_COLS, pca_k)
    feats = materialize(feats)  # read by every scan of the sweep
    rows, models = kmeans_sweep(feats, cols, S.USER, ks, n_init=n_init, seed=seed)
    k = sorted(rows, key=lambda r: (-r[2], r[0]))[0][0]
    seg = rerank_clusters(nearest_centroid(feats, cols, models[k].tolist(), "prediction"), "prediction", "monetary", "cluster")
    return seg.select(S.USER, *RFM_COLS, "cluster"), rows, k
