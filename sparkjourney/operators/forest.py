"""Random forests that are grown in tasks and stay there.

Spark ML's forest has the nodes of all trees on the driver; an unbounded tree has a node
for every few rows, so 100 of them outgrow any driver.  Here a tree is grown inside one
task and kept as a row of a table, with the same steps as Spark's: at most ``BINS`` bins a
column, a bootstrap (Poisson(1) copies of a row), a fresh subset of columns at each node,
the split with the largest Gini gain among those that leave enough copies on both
sides, siblings of one prediction merged, and votes of class shares averaged over the trees.

* Cells: a tree sees a row's bins and its label only, so rows of the same bins are one cell
  with a count for each class.  There are never more cells than rows, nor more than
  ``BINS ** columns``, and a cell of n rows is drawn Poisson(n) times: the same draw as of its rows.
* A task gets all cells (a byte a column and the counts) and grows its trees level by
  level with histograms over many nodes at once.  Draws depend on the seed and the
  tree's number alone, not on tasks or partitions.
* A tree grown to the largest depth of a grid also holds the trees of smaller depths, and
  the first trees of a forest are the smaller forest, so a grid grows each tree once for
  each least number of copies and size of subset.
* Votes are added as whole numbers of ``2 ** -SHIFT``, so sums do not depend on their order.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from sparkjourney.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a column, Spark's default; a bin's number is one byte.
BINS = 32

#: Numbers a column that its bins are made from; Spark takes as many rows.
VALUES = 10_000

#: Votes are whole numbers of 2 ** -SHIFT.
SHIFT = 40

#: Cells in one row of packed cells.
PACK = 1 << 16

#: Bins of all nodes whose histograms a task has at one time.
HISTOGRAM = 1 << 20


@dataclass(frozen=True)
class Forest:
    """What a forest is grown with; ``subset`` columns are looked at for a split."""
    trees: int
    depth: int
    least: int
    subset: int
    seed: int = 42


# --------------------------------------------------------------------------- one tree, in a task

@dataclass
class Tree:
    """Nodes level by level: the right child comes after the left, a leaf's ``left`` is -1."""
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    gain: np.ndarray
    levels: list[int]


def bootstrap(counts: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Copies of each cell and class in the tree's bootstrap."""
    return np.random.default_rng([seed, tree, 0]).poisson(counts).astype(float)


def _best_splits(bins, w, node, subset_of, n, least):
    """For each open node: gain, column and last bin to the left of the best split, and the left side's two counts."""
    nodes, gain = len(n), np.zeros(len(n))
    feature, split, left = np.zeros(nodes, np.int16), np.zeros(nodes, np.uint8), np.zeros((nodes, 2))
    width = [int(b.max()) + 1 if len(b) else 1 for b in bins]
    step = max(1, HISTOGRAM // max(width))
    if nodes > step:  # rows of one block of nodes lie together
        order = np.argsort(node, kind="stable")
        bins, w, node = bins[:, order], w[order], node[order]
    for lo in range(0, nodes, step):
        hi = min(nodes, lo + step)
        part = slice(None) if nodes <= step else slice(*np.searchsorted(node, (lo, hi)))
        at, weights = node[part] - lo, w[part]
        for f in range(len(bins)):
            mine = np.flatnonzero(subset_of[lo:hi, f])
            if width[f] < 2 or not len(mine):
                continue
            place = np.full(hi - lo, -1)
            place[mine] = np.arange(len(mine))
            place = place[at]
            rows = np.flatnonzero(place >= 0)
            key = place[rows] * width[f] + bins[f, part][rows]
            l0, l1 = (np.bincount(key, weights[rows, c], len(mine) * width[f]).reshape(-1, width[f]).cumsum(1)[:, :-1] for c in (0, 1))
            t0, t1 = (n[lo + mine, c][:, None] for c in (0, 1))
            a, total = l0 + l1, t0 + t1
            b = total - a
            ok = (a >= least) & (b >= least)
            lost = l0 * l1 / np.where(ok, a, 1) + (t0 - l0) * (t1 - l1) / np.where(ok, b, 1)
            g = np.where(ok, 2 * (t0 * t1 / total - lost) / total, -1)
            s = g.argmax(1)
            row = np.arange(len(mine))
            better = np.flatnonzero(g[row, s] > gain[lo + mine])
            to, s = lo + mine[better], s[better]
            gain[to], feature[to], split[to] = g[better, s], f, s
            left[to, 0], left[to, 1] = l0[better, s], l1[better, s]
    return gain, feature, split, left


def grow(bins: np.ndarray, copies: np.ndarray, forest: Forest, tree: int) -> Tree:
    """One tree of the ``copies`` (cells, 2) of cells with ``bins`` (columns, cells)."""
    rng, k = np.random.default_rng([forest.seed, tree, 1]), len(bins)
    rows = np.flatnonzero(copies.sum(1))
    bins, w, node = bins[:, rows], copies[rows], np.zeros(len(rows), np.int64)
    n, made, out, levels = w.sum(0)[None, :], 1, [], [0]
    for depth in range(forest.depth + 1):
        here = len(n)
        gain, feature, split, left = np.zeros(here), np.zeros(here, np.int16), np.zeros(here, np.uint8), np.full(here, -1, np.int32)
        open_ = np.flatnonzero((n > 0).all(1)) if depth < forest.depth else np.zeros(0, int)
        children = np.zeros((0, 2))
        if len(open_):
            place = np.full(here, -1)
            place[open_] = np.arange(len(open_))
            keep = np.flatnonzero(place[node] >= 0)
            bins, w, node = bins[:, keep], w[keep], place[node[keep]]
            subset_of = np.zeros((len(open_), k), bool)
            np.put_along_axis(subset_of, rng.random((len(open_), k)).argsort(1)[:, :forest.subset], True, 1)
            g, f, s, l_counts = _best_splits(bins, w, node, subset_of, n[open_], forest.least)
            cut = np.flatnonzero(g > 0)
            to = open_[cut]
            gain[to], feature[to], split[to], left[to] = g[cut], f[cut], s[cut], made + 2 * np.arange(len(cut))
            children = np.stack([l_counts[cut], n[to] - l_counts[cut]], 1).reshape(-1, 2)
            place = np.full(len(open_), -1)
            place[cut] = np.arange(len(cut))
            keep = np.flatnonzero(place[node] >= 0)
            bins, w, node = bins[:, keep], w[keep], node[keep]
            node = 2 * place[node] + (bins[f[node], np.arange(len(node))] > s[node])
        out.append((feature, split, left, n[:, 0], n[:, 1], gain))
        levels.append(levels[-1] + here)
        n, made = children, made + len(children)
        if not len(n):
            break
    return Tree(*(np.concatenate(x) for x in zip(*out)), levels)


def leaves(t: Tree, depth: int) -> np.ndarray:
    """Which nodes end the tree cut at ``depth``: siblings that are leaves of one prediction are merged."""
    stop, says = t.left < 0, t.n1 > t.n0
    if depth < len(t.levels) - 1:
        stop[t.levels[depth]:] = True
    for lo, hi in reversed(list(zip(t.levels, t.levels[1:]))[:depth]):
        own = lo + np.flatnonzero(~stop[lo:hi])
        a, b = t.left[own], t.left[own] + 1
        stop[own] = stop[a] & stop[b] & (says[a] == says[b])
    return stop


def shares(t: Tree) -> np.ndarray:
    """Each node's share of class 1 in whole numbers of 2 ** -SHIFT."""
    return np.rint(t.n1 / np.maximum(t.n0 + t.n1, 1) * (1 << SHIFT)).astype(np.int64)


def importances(t: Tree, stop: np.ndarray, k: int) -> np.ndarray:
    """Gains of the tree by column, weighted with the copies they are made on; they add up to 1 (or 0)."""
    own = np.flatnonzero(~stop)
    x = np.bincount(t.feature[own], t.gain[own] * (t.n0 + t.n1)[own], k)
    return x / x.sum() if x.sum() > 0 else x


def votes(feature, split, left, share, bins: np.ndarray) -> np.ndarray:
    """The tree's vote for each cell; where ``left`` is -1 a path ends."""
    at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while len(rows):
        down = left[at[rows]]
        rows, down = rows[down >= 0], down[down >= 0]
        at[rows] = down + (bins[feature[at[rows]], rows] > split[at[rows]])
    return share[at]


def area(score: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> float:
    """Area under the ROC curve of cells with so many rows of each class, ties by half."""
    if not ones.sum() or not zeros.sum():
        return float(ones.sum() > 0)
    _, at = np.unique(score, return_inverse=True)
    z, o = np.bincount(at, zeros), np.bincount(at, ones)
    return float((o * (z.cumsum() - z / 2)).sum() / (z.sum() * o.sum()))


# --------------------------------------------------------------------------- cells

def cut_values(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """For each column the upper ends of all bins but the last, as Spark's forest sets them, from the
    number of rows of each value, or from ``VALUES`` quantiles of a column with more values."""
    x = [_number(f) for f in features]
    counts = [df.groupBy(c.alias("x")).agg(F.count(F.lit(1)).alias("n")).limit(VALUES + 1).collect() for c in x]
    many = [i for i, c in enumerate(counts) if len(c) > VALUES]
    if many:
        text = ",".join(f"{(j + 0.5) / VALUES:.9g}" for j in range(VALUES))
        probs = F.expr(f"cast(split('{text}', ',') AS array<double>)")  # one constant, not a column for each number
        row = df.agg(*[F.percentile_approx(F.when(~F.isnan(x[i]), x[i]), probs, F.lit(10 * VALUES)).alias(f"q{i}") for i in many],
                     *[F.avg(F.isnan(x[i]).cast("double")).alias(f"s{i}") for i in many]).first()
        for i in many:
            missing = row[f"s{i}"]
            counts[i] = [(v, 1.0) for v in row[f"q{i}"]] + ([(math.nan, VALUES * missing / (1 - missing))] if missing else [])
    return [_cuts(c, bins) for c in counts]


def _cuts(counts: Sequence[tuple[float, float]], bins: int) -> np.ndarray:
    """Cuts between neighbouring values, ``bins`` - 1 at most: after the values whose running count is nearest
    to the next multiple of an equal share.  NaN is the largest value."""
    if not counts:
        return np.zeros(0)
    values, at = np.unique(np.array([v for v, _ in counts], float), return_inverse=True)
    total = np.bincount(at, [n for _, n in counts]).cumsum()
    middle = np.where(np.isnan(values[1:]), values[:-1], values[:-1] / 2 + values[1:] / 2)
    if len(middle) >= bins:
        chosen, share = [], total[-1] / bins
        for i in range(len(middle)):
            target = (len(chosen) + 1) * share
            if abs(total[i] - target) < abs(total[i + 1] - target):
                chosen.append(i)
        middle = middle[chosen]
    return np.unique(middle[~np.isnan(middle)])


def _number(f: str):
    """The column as DOUBLE; NULL is NaN, which is above all cut values."""
    return F.coalesce(F.col(f).cast("double"), F.lit(math.nan))


def cell_of(features: Sequence[str], cuts: Sequence[np.ndarray]):
    """Column: a row's bins, one byte for each feature."""
    @F.arrow_udf("binary")
    def cell(*cols: pa.Array) -> pa.Array:
        b = np.stack([np.searchsorted(c, x.to_numpy(zero_copy_only=False)) for c, x in zip(cuts, cols)], 1).astype(np.uint8)
        ends = pa.py_buffer(np.arange(0, b.size + 1, len(cuts), dtype=np.int32))
        return pa.Array.from_buffers(pa.binary(), len(b), [None, ends, pa.py_buffer(b.tobytes())])

    return cell(*[_number(f) for f in features])


def pack(cells: DataFrame, counts: Sequence[str] = (), size: int = PACK) -> DataFrame:
    """(chunk, codes, counts): up to ``size`` cells a row."""
    def chunks(batches):
        task, i = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                codes = b"".join(part.column(0).to_pylist())
                numbers = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns[1:]], 1).tobytes() if counts else b""
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | i], pa.int64()), pa.array([codes], pa.binary()), pa.array([numbers], pa.binary())], ["chunk", "codes", "counts"])
                i += 1

    return cells.select("_cell", *counts).mapInArrow(chunks, "chunk long, codes binary, counts binary")


def _unpack(codes: Sequence[bytes], counts: Sequence[bytes], k: int, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins (columns, cells) and counts (cells, numbers) of packed cells, in the order of their bins."""
    c = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, k)
    n = np.frombuffer(b"".join(counts), np.int64).reshape(-1, numbers)
    order = np.lexsort(c.T[::-1])
    return np.ascontiguousarray(c[order].T), n[order]


def _blocks(df: DataFrame, ends: Sequence[int]) -> list[tuple[int, int]]:
    """(first tree, end) for each task: the trees up to each of ``ends``, cut into four blocks a core in all."""
    step = max(1, math.ceil(ends[-1] / (4 * df.sparkSession.sparkContext.defaultParallelism)))
    return [(a, min(a + step, hi)) for lo, hi in zip([0, *ends], ends) for a in range(lo, hi, step)]


def _in_tasks(chunks: DataFrame, blocks: Sequence[tuple[int, int]], work, schema: str, k: int, numbers: int) -> DataFrame:
    """The rows that ``work(first tree, end, bins, counts)`` gives for each block, in a task of its own over all cells."""
    def run(batches):
        block, codes, counts = None, [], []
        for b in batches:
            for task, c, n in zip(*(b.column(x).to_pylist() for x in ("task", "codes", "counts"))):
                block = task
                codes.append(c)
                counts.append(n)
        if block is not None:
            bins, n = _unpack(codes, counts, k, numbers)
            codes.clear(), counts.clear()
            yield from work(*blocks[block], bins, n)

    tasks = chunks.sparkSession.range(len(blocks)).select(F.col("id").cast("int").alias("task"))
    return (chunks.crossJoin(F.broadcast(tasks)).select("task", "codes", "counts")
            .repartitionById(len(blocks), F.col("task")).mapInArrow(run, schema))


def _row(schema: str, *values) -> pa.RecordBatch:
    names, types = zip(*(x.split(" ", 1) for x in schema.split(", ")))
    arrow = {"int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array([v], arrow[t]) for v, t in zip(values, types)], list(names))


# --------------------------------------------------------------------------- forests

TREES = "tree int, feature binary, split binary, left binary, share binary, importance array<double>"
PARTS = "grown int, depth int, segment int, held binary, votes binary"


def fit_forest(train: DataFrame, features: Sequence[str], label: str, forest: Forest) -> ForestModel:
    """The forest of the train rows (labels 0 and 1)."""
    k, features = len(list(features)), list(features)
    cuts = cut_values(train, features)
    cells = train.withColumn("_cell", cell_of(features, cuts)).groupBy("_cell").agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))

    def work(lo, hi, bins, counts) -> Iterator[pa.RecordBatch]:
        for i in range(lo, hi):
            t = grow(bins, bootstrap(counts, forest.seed, i), forest, i)
            stop = leaves(t, forest.depth)
            left = np.where(stop, -1, t.left)
            yield _row(TREES, i, *(x.tobytes() for x in (t.feature, t.split, left, shares(t))), importances(t, stop, k).tolist())

    chunks = materialize(pack(cells, ("n0", "n1")))
    trees = materialize(_in_tasks(chunks, _blocks(train, [forest.trees]), work, TREES, k, 2))
    by_tree = np.array([r.importance for r in trees.select("tree", "importance").orderBy("tree").collect()])
    total = by_tree.sum(0)
    return ForestModel(trees, features, cuts, forest.trees, total / total.sum() if total.sum() > 0 else total)


def grid_areas(fit: DataFrame, held: DataFrame, features: Sequence[str], label: str, grid: Sequence[Forest]) -> list[float]:
    """For each forest of the grid (all of one seed), grown on ``fit``, the area under the ROC curve of the ``held`` rows."""
    k, features, seed = len(list(features)), list(features), grid[0].seed
    cuts = cut_values(fit, features)
    rows = fit.select(*features, label, F.lit(False).alias("_held")).unionByName(held.select(*features, label, F.lit(True).alias("_held")))
    names = ("n0", "n1", "h0", "h1")
    cells = rows.withColumn("_cell", cell_of(features, cuts)).groupBy("_cell").agg(
        *[F.count_if((F.col(label) == c) & (F.col("_held") == (h == "h"))).alias(f"{h}{c}") for h in "nh" for c in (0, 1)])
    ends = sorted({g.trees for g in grid})
    grown = sorted({(g.least, g.subset) for g in grid})
    depths = {x: sorted({g.depth for g in grid if (g.least, g.subset) == x}) for x in grown}
    blocks = _blocks(fit, ends)

    def work(lo, hi, bins, counts) -> Iterator[pa.RecordBatch]:
        seen = np.flatnonzero(counts[:, 2:].sum(1))
        asked, weight = bins[:, seen], counts[seen, 2:].tobytes() if lo == 0 else None
        for j, (least, subset) in enumerate(grown):
            own = depths[least, subset]
            sums = [np.zeros(len(seen), np.int64) for _ in own]
            for i in range(lo, hi):
                t = grow(bins, bootstrap(counts[:, :2], seed, i), Forest(hi, own[-1], least, subset, seed), i)
                share = shares(t)
                for depth, s in zip(own, sums):
                    s += votes(t.feature, t.split, np.where(leaves(t, depth), -1, t.left), share, asked)
            for depth, s in zip(own, sums):
                yield _row(PARTS, j, depth, next(e for e, x in enumerate(ends) if lo < x), weight, s.tobytes())

    def measured(parts: pd.DataFrame) -> pd.DataFrame:
        weight = np.frombuffer(next(x for x in parts.held if x is not None), np.int64).reshape(-1, 2)
        total, out = np.zeros(len(weight), np.int64), []
        for e, end in enumerate(ends):
            for x in parts.votes[parts.segment == e]:
                total = total + np.frombuffer(x, np.int64)
            out.append((parts.grown.iloc[0], parts.depth.iloc[0], end, area(total, weight[:, 0], weight[:, 1])))
        return pd.DataFrame(out, columns=["grown", "depth", "trees", "area"])

    parts = _in_tasks(materialize(pack(cells, names)), blocks, work, PARTS, k, len(names))
    found = {(grown[r.grown], r.depth, r.trees): r.area for r in
             parts.groupBy("grown", "depth").applyInPandas(measured, "grown int, depth int, trees int, area double").collect()}
    return [found[(g.least, g.subset), g.depth, g.trees] for g in grid]


class ForestModel(Model, MLWritable, MLReadable):
    """A grown forest: a table with a row for each tree.  Adds rawPrediction, probability
    and prediction, as Spark's forest does."""

    def __init__(self, trees: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], number: int, importance):
        super().__init__()
        self.trees, self.features, self.cuts, self.number = trees, list(features), list(cuts), number
        self.featureImportances = DenseVector(importance)

    @property
    def getNumTrees(self) -> int:
        return self.number

    def copy(self, extra=None):
        return self

    def _votes(self, cells: DataFrame) -> DataFrame:
        """(_cell, _votes): the sum of the trees' votes for each cell."""
        k = len(self.features)

        def part(batches):
            sums: dict = {}
            for b in batches:
                for i in range(b.num_rows):
                    r = {c: b.column(c)[i].as_py() for c in ("chunk", "codes", "feature", "split", "left", "share")}
                    bins = np.frombuffer(r["codes"], np.uint8).reshape(-1, k).T
                    v = votes(*(np.frombuffer(r[c], d) for c, d in (("feature", np.int16), ("split", np.uint8), ("left", np.int32), ("share", np.int64))), bins)
                    sums[r["chunk"]] = (r["codes"], sums[r["chunk"]][1] + v if r["chunk"] in sums else v)
            for chunk, (codes, v) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([codes], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["chunk", "codes", "votes"])

        def whole(parts: pd.DataFrame) -> pd.DataFrame:
            codes = parts.codes.iloc[0]
            return pd.DataFrame({"_cell": [codes[i:i + k] for i in range(0, len(codes), k)],
                                 "_votes": sum(np.frombuffer(v, np.int64) for v in parts.votes)})

        chunks = materialize(pack(cells, size=4 * PACK))
        pairs = self.trees.drop("tree", "importance").crossJoin(chunks.drop("counts"))
        return (pairs.mapInArrow(part, "chunk long, codes binary, votes binary")
                .groupBy("chunk").applyInPandas(whole, "_cell binary, _votes long"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = materialize(dataset.withColumn("_cell", cell_of(self.features, self.cuts)))
        ones = F.col("_votes") / F.lit(float(1 << SHIFT))
        return (rows.join(self._votes(rows.select("_cell").distinct()), "_cell")
                .withColumn("rawPrediction", array_to_vector(F.array(F.lit(float(self.number)) - ones, ones)))
                .withColumn("probability", array_to_vector(F.array(F.lit(1.0) - ones / self.number, ones / self.number)))
                .withColumn("prediction", (2 * F.col("_votes") > F.lit(self.number << SHIFT)).cast("double"))
                .drop("_cell", "_votes"))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        more = {"features": m.features, "cuts": [c.tolist() for c in m.cuts], "number": m.number, "importance": m.featureImportances.toArray().tolist()}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"forest": more})
        m.trees.write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        x = meta["forest"]
        m = self.cls(self.sparkSession.read.parquet(f"{path}/trees"), x["features"], [np.array(c, float) for c in x["cuts"]], x["number"], x["importance"])
        m._resetUid(meta["uid"])
        return m
