"""K-means for many numbers of clusters and many starts at once.

Every model of a sweep (each k, each start) is advanced in the same scan: an
iteration assigns all rows under all models, adds up (rows, sums, squared
distances) per (model, cluster) inside each task, and merges these few numbers
with one grouped aggregate.  A sweep of 9 values of k with 10 starts is one chain
of scans, not 90 fits.  The rows of a task are worked on batch by batch with matrix
products; a task emits at most one row per (model, cluster).

* Starts: k-means++ by hashing.  A row's weight is its squared distance to the
  start's centres so far; the row with the smallest ``-log(u) / weight``, with u
  from the row's key, is a draw by these weights.  The first k centres of a start
  serve every k, so seeding costs as many scans as the largest k.
* A model is done when no centre moved by more than ``tol``; a centre without rows
  stays where it is.
* Silhouettes (squared Euclidean) come from per-cluster counts, sums and square
  sums, in one scan for all models.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A model: its centres, one row each.
Models = dict[tuple, np.ndarray]


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The batch's first ``d`` columns, each of them contiguous."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)]).T


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre (of equally near ones the first), and the squared distance
    to it.  One centre at a time over whole columns: no (rows, centres, columns) block."""
    near, low = np.zeros(len(x), np.intp), np.full(len(x), np.inf)
    for c, centre in enumerate(centres):
        far = (x[:, 0] - centre[0]) ** 2
        for j in range(1, x.shape[1]):
            far += (x[:, j] - centre[j]) ** 2
        near[far < low] = c
        np.minimum(low, far, out=low)
    return near, low


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1] for each key: 64 bits mixed with the salt."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 1) / float(1 << 53)


def _numbers(df: DataFrame, cols: Sequence[str], *more) -> DataFrame:
    cols = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    out = df.select(*cols, *more)
    return out.where(" AND ".join(f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(len(cols))))


def seed_centres(df: DataFrame, cols: Sequence[str], key: str, k: int, starts: int, seed: int = 42) -> list[np.ndarray]:
    """For each start up to k distinct centres, in the order in which they were drawn."""
    d = len(cols)
    data = _numbers(df, cols, F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    chosen = [np.zeros((0, d)) for _ in range(starts)]
    for step in range(k):
        def draw(batches, chosen=chosen, step=step):
            best = {}
            for b in batches:
                x, h = _rows(b, d), b.column(d).to_numpy()
                for s, have in enumerate(chosen):
                    if len(have) < step:
                        continue  # no further distinct row
                    weight = _nearest(x, have)[1] if step else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        race = np.where(weight > 0, -np.log(_uniform(h, s * 1000 + step)) / weight, np.inf)
                    i = race.argmin() if len(race) else None
                    if i is not None and np.isfinite(race[i]) and (s not in best or race[i] < best[s][0]):
                        best[s] = (race[i], x[i].tolist())
            yield pa.RecordBatch.from_pylist([{"s": s, "race": float(r), "x": x} for s, (r, x) in best.items()], schema=pa.schema(
                [("s", pa.int32()), ("race", pa.float64()), ("x", pa.list_(pa.float64()))]))

        drawn = data.mapInArrow(draw, "s int, race double, x array<double>").groupBy("s").agg(F.min(F.struct("race", "x")).alias("b"))
        for r in drawn.collect():  # one row a start
            chosen[r.s] = np.vstack([chosen[r.s], r.b.x])
    return chosen


def _totals(data: DataFrame, models: Models, d: int) -> dict[tuple, tuple]:
    """{(model, cluster): (rows, sums, squared norms, squared distances)}: one scan for all models."""
    names = list(models)
    centres = [models[m] for m in names]

    def add(batches):
        held = [np.zeros((len(c), d + 3)) for c in centres]
        for b in batches:
            x = _rows(b, d)
            norms = (x ** 2).sum(1)
            for own, c in zip(held, centres):
                near, low = _nearest(x, c)
                own[:, 0] += np.bincount(near, minlength=len(c))
                for j, v in enumerate([*x.T, norms, low], 1):
                    own[:, j] += np.bincount(near, v, len(c))
        out = [{"m": m, "c": c, "v": row.tolist()} for m, own in enumerate(held) for c, row in enumerate(own) if row[0]]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("m", pa.int32()), ("c", pa.int32()), ("v", pa.list_(pa.float64()))]))

    parts = data.mapInArrow(add, "m int, c int, v array<double>").groupBy("m", "c").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(d + 3)])
    return {(names[r.m], r.c): (r.v0, np.array([r[f"v{1 + j}"] for j in range(d)]), r[f"v{d + 1}"], r[f"v{d + 2}"]) for r in parts.collect()}


def lloyd(df: DataFrame, cols: Sequence[str], models: Models, max_iter: int = 300, tol: float = 1e-4) -> tuple[Models, dict]:
    """The models after at most ``max_iter`` steps, and {model: inertia} of the
    centres returned.  Rows with a NULL or NaN are left out; ``df`` is scanned once
    a step, by all models that still move, and once more at the end."""
    data, d = _numbers(df, cols), len(cols)
    models, moving = dict(models), set(models)
    for _ in range(max_iter):
        found = _totals(data, {m: models[m] for m in models if m in moving}, d)
        for m in list(moving):
            now = np.array([found[m, c][1] / found[m, c][0] if (m, c) in found else old for c, old in enumerate(models[m])])
            if np.sqrt(((now - models[m]) ** 2).sum(1)).max() <= tol:
                moving.discard(m)
            models[m] = now
        if not moving:
            break
    found = _totals(data, models, d)
    return models, {m: float(sum(found[m, c][3] for c in range(len(models[m])) if (m, c) in found)) for m in models}


def silhouettes(df: DataFrame, cols: Sequence[str], models: Models) -> dict[tuple, float]:
    """{model: mean silhouette} with squared Euclidean distances; rows alone in
    their cluster count 0.  The mean squared distance of a row x to a cluster of n
    rows with sum Y and square sum Q is |x|^2 + Q/n - 2 x.Y/n."""
    data, d = _numbers(df, cols), len(cols)
    found = _totals(data, models, d)
    names = list(models)
    facts = []
    for m in names:
        n = np.array([found[m, c][0] if (m, c) in found else 0.0 for c in range(len(models[m]))])
        y = np.array([found[m, c][1] if (m, c) in found else np.zeros(d) for c in range(len(models[m]))])
        q = np.array([found[m, c][2] if (m, c) in found else 0.0 for c in range(len(models[m]))])
        facts.append((models[m], n, y, q))

    def score(batches):
        sums = np.zeros((len(facts), 2))
        for b in batches:
            x = _rows(b, d)
            at = np.arange(len(x))
            for i, (centres, n, y, q) in enumerate(facts):
                near = _nearest(x, centres)[0]
                mean = (x ** 2).sum(1)[:, None] + (q / np.maximum(n, 1))[None] - 2 * x @ (y / np.maximum(n, 1)[:, None]).T
                mean = np.where(n[None] > 0, np.maximum(mean, 0), np.inf)
                own = n[near]
                a = mean[at, near] * own / np.maximum(own - 1, 1)
                mean[at, near] = np.inf
                b_ = mean.min(1)
                top = np.maximum(a, b_)
                s = np.where((own > 1) & np.isfinite(b_) & (top > 0), (b_ - a) / np.where(top > 0, top, 1), 0.0)
                sums[i] += s.sum(), len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(facts)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["m", "s", "n"])

    parts = data.mapInArrow(score, "m int, s double, n double").groupBy("m").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return {names[r.m]: float(r.s / r.n) if r.n else 0.0 for r in parts.collect()}


def kmeans_sweep(df: DataFrame, cols: Sequence[str], key: str, ks: Sequence[int] = range(2, 11), n_init: int = 10, seed: int = 42,
                 max_iter: int = 300, tol: float = 1e-4) -> tuple[list[tuple], dict[int, np.ndarray]]:
    """Rows (k, inertia, silhouette) of the best of ``n_init`` starts for each k, and
    its centres.  ``df`` is scanned many times: materialize it."""
    ks = list(ks)
    chosen = seed_centres(df, cols, key, max(ks), n_init, seed)
    if not any(len(c) for c in chosen):
        return [], {}
    models, inertia = lloyd(df, cols, {(k, s): c[:k] for k in ks for s, c in enumerate(chosen) if len(c)}, max_iter, tol)
    best = {k: min((m for m in models if m[0] == k), key=lambda m: (inertia[m], m[1])) for k in ks}
    sil = silhouettes(df, cols, {m: models[m] for m in best.values()})
    return [(k, inertia[best[k]], sil[best[k]]) for k in ks], {k: models[best[k]] for k in ks}
