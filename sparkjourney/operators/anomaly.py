"""Anomalies: event-count spikes, suspicious timelines, Isolation Forest on RFM.

Spikes: per-user counts of the watched event types (grouped aggregate with
partial aggregation), then an exact 95th percentile of those counts through a
scalar subquery.  ``percentile`` keeps a map of distinct value -> frequency,
and per-user counts take few distinct values, so its state stays small; the
threshold is strict (a count equal to the percentile is not a spike).

Isolation Forest (not in Spark ML) is built from Spark primitives:

1. sampling: every tree takes every row at the same rate r, independently of
   the other trees, whatever the table's size.  One hash of the key says which
   tree is the row's first (geometric in r), and most rows have none; only the
   others hash (key, tree, seed) for the trees after it.  Deterministic under
   any partitioning; ``explode`` emits one row per (tree, row) picked;
2. fitting: ``groupBy(tree).applyInPandas`` keeps the ``sample`` rows with
   the smallest hashes and grows one small tree with NumPy.  Each group
   holds about twice ``sample`` rows whatever the table size;
3. scoring: the forest is a node table (trees x at most 2*sample-1 rows: a fixed
   bound) that is broadcast.  A row stands at the root of every tree and moves down
   by one broadcast join a level; its paths are added up inside the task, so one
   row per scored row is shuffled and no Python runs (``score_forest``);
4. the cut-off is the exact ``1 - contamination`` quantile of the scores
   (``exact_quantiles``, a distributed sort), through a scalar subquery.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparkjourney import schema as S
from sparkjourney.functions.scalar import fit_row, with_scalar
from sparkjourney.operators.quantiles import exact_quantiles


# --------------------------------------------------------------------------- spikes

def event_counts(events: DataFrame, types: Sequence[str], user: str = S.USER, event: str = S.EVENT) -> DataFrame:
    """(user, event_count) over events of the given types; users without any are absent."""
    return (events.where(F.col(event).isin(list(types)) & F.col(user).isNotNull())
            .groupBy(user).agg(F.count(F.lit(1)).alias("event_count")))


def event_spikes(events: DataFrame, types: Sequence[str] = tuple(S.CLICKSTREAM_SPIKE_TYPES), q: float = 0.95,
                 user: str = S.USER,
                 event: str = S.EVENT) -> DataFrame:
    """(user, event_count) of users whose count is strictly above the q-quantile
    (linear interpolation) of the per-user counts."""
    counts = event_counts(events, types, user, event)
    thr = counts.select(F.percentile("event_count", F.lit(q))).scalar()
    return counts.where(F.col("event_count") > thr)


def spike_threshold(events: DataFrame, types: Sequence[str], q: float = 0.95) -> DataFrame:
    counts = event_counts(events, types)
    return counts.agg(F.percentile("event_count", F.lit(q)).alias("threshold"))


def suspicious_timeline(events: DataFrame, spikes: DataFrame, n_users: int = 3, user: str = S.USER,
                        event: str = S.EVENT, ts: str = S.TS, order: str = "user") -> DataFrame:
    """All events of ``n_users`` spike users, in time order.

    ``order='user'`` picks the lowest user ids (what the analysis does),
    ``order='count'`` the largest spike counts (ties: lower id).  The chosen
    ids are an ``n_users``-row table (broadcast, fixed bound).
    """
    keys = [F.asc(user)] if order == "user" else [F.desc("event_count"), F.asc(user)]
    chosen = F.broadcast(spikes.orderBy(*keys).limit(n_users).select(user))
    return (events.join(chosen, user, "left_semi").select(user, event, ts)
            .orderBy(user, ts, *[c for c in (S.EVENT_ID,) if c in events.columns]))


def spike_share(events: DataFrame, spikes: DataFrame, user: str = S.USER) -> DataFrame:
    """(category, users, share): normal vs spike users among all users."""
    n_spike = spikes.select(F.countDistinct(user).alias("n"))
    total = F.col("_t")["total"]
    one = with_scalar(n_spike, "_t", events.select(F.countDistinct(user).alias("total")))
    normal_label, spike_label = S.SPIKE_SHARE_LABELS
    rows = F.array(F.struct(F.lit(normal_label).alias("category"), (total - F.col("n")).alias("users"),
                            total.alias("_total")),
                   F.struct(F.lit(spike_label).alias("category"), F.col("n").alias("users"),
                            total.alias("_total")))
    return (one.select(F.inline(rows)).withColumn("share", F.col("users") / F.col("_total"))
            .drop("_total"))


# --------------------------------------------------------------------------- isolation forest

_EULER = 0.5772156649015329


def _ship_by_value() -> None:
    """Serialize this module's worker-side helpers by value, so Python workers
    need only NumPy/pandas, not this package on their path."""
    import sys
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _c(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + _EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Grow one isolation tree; returns node arrays (feature, threshold, left, right, size)."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return i
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[i], thr[i] = f, t
        mask = sub[:, f] < t
        left[i] = node(idx[mask], depth + 1)
        right[i] = node(idx[~mask], depth + 1)
        return i

    node(np.arange(len(x)), 0)
    return feat, thr, left, right, size


def _tree_nodes_schema():
    return "tree int, node int, feature int, threshold double, left int, right int, size int"


def isolation_forest(df: DataFrame, cols: Sequence[str], key: str = S.USER, trees: int = 100, sample: int = 256,
                     contamination: float = 0.02, seed: int = 42, oversample: float = 2.0) -> DataFrame:
    """Add ``anomaly_score`` (higher = more isolated) and ``anomaly`` (-1 / 1)."""
    _ship_by_value()
    cols = list(cols)
    # per-tree inclusion rate (oversampled; each tree keeps its `sample` smallest hashes)
    base = with_scalar(df, "_n", df.agg(F.count(F.lit(1)).alias("n")))
    rate = F.least(F.lit(1.0), F.lit(oversample * sample) / F.col("_n")["n"])

    def h(*salt):
        return F.pmod(F.xxhash64(F.col(key), *salt, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    # rows whose first tree lies beyond the last are in none and never expand
    base = base.withColumn("_r", rate).withColumn("_first", F.when(F.col("_r") >= 1, F.lit(0.0)).otherwise(
        F.floor(F.log1p(-h(F.lit(-1))) / F.log1p(-F.col("_r")))))
    members = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                       lambda t: (t == F.col("_first")) | ((t > F.col("_first")) & (h(t) < F.col("_r"))))
    picked = (base.where(F.col("_first") < trees)
              .select(key, *[F.col(c).cast("double").alias(c) for c in cols], F.explode(members).alias("tree"))
              .withColumn("_h", h(F.col("tree"), F.lit("order"))))
    max_depth = int(math.ceil(math.log2(max(sample, 2))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", key]).head(sample)
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, t])
        feat, thr, left, right, size = _grow(pdf[cols].to_numpy(dtype=float), rng, max_depth)
        n = len(feat)
        return pd.DataFrame({"tree": np.full(n, t, dtype="int32"), "node": np.arange(n, dtype="int32"),
                             "feature": np.asarray(feat, dtype="int32"), "threshold": np.asarray(thr, dtype=float),
                             "left": np.asarray(left, dtype="int32"), "right": np.asarray(right, dtype="int32"),
                             "size": np.asarray(size, dtype="int32")})

    from sparkjourney.session import materialize
    nodes = materialize(picked.groupBy("tree").applyInPandas(fit, _tree_nodes_schema()))
    # scored once: the cut-off and the flags both read the checkpoint
    return flag_anomalies(materialize(score_forest(df, cols, nodes, sample)), contamination)


def score_forest(df: DataFrame, cols: Sequence[str], nodes: DataFrame, sample: int, name: str = "anomaly_score") -> DataFrame:
    """Add the anomaly score 2^(-mean path / c(sample)) of a forest given as a node
    table: (tree, node, feature or -1, threshold, left, right, size), a root being node 0.
    A path is a row's depth at its leaf plus the expected path of a search in the leaf.

    ``sample`` is the number of rows a tree was grown from (at most).  Rows are told
    apart by their place, so repeated rows stay."""
    shape = fit_row(nodes.agg(F.array_sort(F.collect_set("tree")).alias("trees"), F.max(F.when(F.col("node") == 0, F.col("size"))).alias("root")))
    norm = float(_c([float(min(sample, max(1, shape["root"] or 1)))])[0]) or 1.0
    n = F.col("size").cast("double")
    rest = F.when(n > 2, F.lit(2.0) * (F.log(n - 1) + F.lit(_EULER)) - F.lit(2.0) * (n - 1) / n).when(n == 2, F.lit(1.0)).otherwise(F.lit(0.0))
    table = F.broadcast(nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("feature").alias("_f"), F.col("threshold").alias("_cut"),
                                     F.col("left").alias("_low"), F.col("right").alias("_high"), rest.alias("_rest")))
    rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_tree", F.explode(F.array(*[F.lit(t) for t in shape["trees"]])))
    rows = rows.withColumn("_node", F.lit(0)).withColumn("_depth", F.lit(0))
    value = F.lit(None).cast("double")
    for i, c in enumerate(cols):
        value = F.when(F.col("_f") == i, F.col(c).cast("double")).otherwise(value)
    levels = int(math.ceil(math.log2(max(sample, 2))))
    own = rows.columns
    for level in range(levels + 1):
        at = rows.join(table, (F.col("_tree") == F.col("_t")) & (F.col("_node") == F.col("_n")))
        if level == levels:
            break
        inner = F.col("_f") >= 0
        down = F.when(value < F.col("_cut"), F.col("_low")).otherwise(F.col("_high"))
        rows = (at.withColumn("_node", F.when(inner, down).otherwise(F.col("_node")))
                .withColumn("_depth", F.col("_depth") + inner.cast("int"))).select(*own)
    total = at.groupBy("_row").agg(F.any_value(F.struct(*df.columns)).alias("_of"), F.sum(F.col("_depth") + F.col("_rest")).alias("_path"))
    return total.select("_of.*", F.pow(F.lit(2.0), -(F.col("_path") / F.lit(float(len(shape["trees"])))) / F.lit(norm)).alias(name))


def flag_anomalies(scored: DataFrame, contamination: float, score: str = "anomaly_score") -> DataFrame:
    """Add ``anomaly``: -1 where the score is above its exact 1 - ``contamination`` quantile, else 1."""
    cut = exact_quantiles(scored, score, [1.0 - contamination]).select("quantile").scalar()
    return scored.withColumn("anomaly", F.when(F.col(score) > cut, F.lit(-1)).otherwise(F.lit(1)))


def rfm_anomalies(rfm_df: DataFrame, cols: Sequence[str] = ("recency", "frequency", "monetary"),
                  contamination: float = 0.02, trees: int = 100, sample: int = 256, seed: int = 42,
                  forest: DataFrame | None = None) -> DataFrame:
    """Isolation Forest on standardized RFM; returns rfm + anomaly_score + anomaly.

    ``forest``: the node table of a forest over the z-scores that is known already;
    else one is grown."""
    from sparkjourney.operators.stats import standardize
    from sparkjourney.session import materialize

    z = standardize(rfm_df, list(cols), fit="row")
    zc = [c + "_z" for c in cols]
    if forest is None:
        out = isolation_forest(z, zc, trees=trees, sample=sample, contamination=contamination, seed=seed)
    else:
        out = flag_anomalies(materialize(score_forest(z, zc, forest, sample)), contamination)
    return out.drop(*zc)
