"""Truncated SVD of a sparse (row, column, value) table by block Krylov iteration.

The matrix stays a long table.  A step multiplies it with a narrow block and back
(two joins and two grouped aggregates), takes off what the earlier blocks span,
and orthonormalises the rest.  Only products of blocks, a few hundred numbers
square, reach the driver.  The steps also give the projection of A'A on the
blocks' span (Rayleigh-Ritz), so the singular values are known after every step;
it ends when the wanted ones stand still or nothing new is found.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from sparkjourney.operators.quantiles import BROADCAST_NUMBERS
from sparkjourney.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns of a block beyond the factors asked for, and steps at most.
EXTRA = 10
MAX_STEPS = 20


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * x.shape[1]), pa.array(x.ravel()))


def gram(df: DataFrame, a: str, b: str, rows: int, cols: int) -> np.ndarray:
    """The product a'b of two blocks, added up in the tasks and then over them."""
    if not rows or not cols:
        return np.zeros((rows, cols))

    def run(batches):
        total = np.zeros((rows, cols))
        for batch in batches:
            total += _matrix(batch.column(0)).T @ _matrix(batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), _lists(total)], names=["i", "v"])

    parts = df.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(run, "i int, v array<double>")
    out = np.zeros((rows, cols))
    for r in parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(cols)]).collect():
        out[r.i] = r[1:]
    return out


def combined(df: DataFrame, key: str, keep: list[str], terms: dict[str, np.ndarray], name: str) -> DataFrame:
    """(key, keep..., name): the sum of the blocks, each times its small matrix."""
    kind = dict(df.dtypes)[key]
    names, small = list(terms), list(terms.values())

    def run(batches):
        for batch in batches:
            x = sum(_matrix(batch.column(1 + len(keep) + i)) @ m for i, m in enumerate(small))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1 + len(keep)], _lists(x)], names=["key", *keep, name])

    held = df.select(F.col(key).alias("key"), *keep, *[F.col(n).alias(f"t_{n}") for n in names])
    return held.mapInArrow(run, f"key {kind}, {''.join(f'{c} array<double>, ' for c in keep)}{name} array<double>").withColumnRenamed("key", key)


def times(triples: DataFrame, block: DataFrame, on: str, to: str, value: str, width: int, rows: int) -> DataFrame:
    """(to, y): the matrix times the block of so many rows, which is broadcast while it is small."""
    block = block.select(F.col(on).alias("_on"), F.col(block.columns[-1]).alias("_b"))
    block = F.broadcast(block) if rows * width <= BROADCAST_NUMBERS else block
    each = triples.join(block, F.col(on) == F.col("_on"))
    summed = each.groupBy(to).agg(*[F.sum(F.col(value) * F.col("_b")[j]).alias(f"y{j}") for j in range(width)])
    return summed.select(to, F.array(*[f"y{j}" for j in range(width)]).alias("y"))


def side_by_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, k, w): two blocks of one row per key as one."""
    none = F.lit(None).cast("array<double>")
    both = a.select(key, F.col(a.columns[-1]).alias("k"), none.alias("w")).unionByName(b.select(key, none.alias("k"), F.col(b.columns[-1]).alias("w")))
    return both.groupBy(key).agg(F.any_value("k", True).alias("k"), F.any_value("w", True).alias("w"))


def _basis(g: np.ndarray, least: float) -> np.ndarray:
    """The matrix that makes a block with this Gram matrix orthonormal, without
    directions whose square length is ``least`` or below."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    keep = values > least
    return vectors[:, keep] / np.sqrt(values[keep])


def truncated_svd(triples: DataFrame, row: str, col: str, value: str, factors: int, tol: float = 1e-10,
                  max_steps: int = MAX_STEPS, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """((row, f), singular values): f holds a row's U * sigma, largest first; fewer than
    ``factors`` if the matrix has no more.  One triple per (row, col); NULL keys and
    values are left out.  ``triples`` is read twice a step: materialize it."""
    t = triples.where(F.col(row).isNotNull() & F.col(col).isNotNull() & F.col(value).isNotNull()).select(row, col, F.col(value).cast("double").alias(value))
    cols = materialize(t.select(col).distinct())
    n_cols, n_rows = cols.count(), t.select(row).distinct().count()
    width = min(factors + EXTRA, n_cols)
    if not width:
        return t.select(row, F.array().cast("array<double>").alias("f")), np.zeros(0)
    draw = [F.pmod(F.xxhash64(F.col(col), F.lit(j), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53)) - F.lit(0.5) for j in range(width)]
    block = materialize(cols.select(col, F.array(*draw).alias("b")))
    basis = _basis(gram(block, "b", "b", width, width), 1e-9)
    span = materialize(combined(block, col, [], {"b": basis}, "k"))
    block, own, inner, ritz = span, basis.shape[1], np.zeros((0, 0)), np.zeros(0)
    for step in range(max_steps):
        y = times(t, block, col, row, value, own, n_cols)
        both = materialize(side_by_side(span, times(t, y, row, col, value, own, n_rows), col))
        dims = len(inner) + own
        g = gram(both.withColumn("kw", F.concat("k", "w")), "kw", "w", dims + own, own)
        cross, square = g[:dims], g[dims:]  # cross: the newest columns of the projection of A'A
        inner = np.block([[inner, cross[:len(inner)]], [cross[:len(inner)].T, cross[len(inner):]]])
        before, ritz = ritz, np.sqrt(np.maximum(np.linalg.eigvalsh((inner + inner.T) / 2)[::-1][:factors], 0))
        if len(before) == len(ritz) and np.all(np.abs(ritz - before) <= tol * ritz[0]) or step == max_steps - 1 or dims == n_cols:
            break
        # the rest beside the span; what rounding leaves of the span in it is taken off in a second pass
        new = _basis(square - cross.T @ cross, 1e-10 * np.trace(square))
        if not new.shape[1]:
            break
        rest = materialize(combined(both, col, ["k"], {"k": -cross @ new, "w": new}, "b"))
        g = gram(rest.withColumn("kb", F.concat("k", "b")), "kb", "b", dims + new.shape[1], new.shape[1])
        cross, square = g[:dims], g[dims:]
        new = _basis(square - cross.T @ cross, 0.25)
        if not new.shape[1]:
            break
        block = materialize(combined(rest, col, ["k"], {"k": -cross @ new, "b": new}, "b"))
        span, own = block.select(col, F.concat("k", "b").alias("k")), new.shape[1]
        block = block.select(col, "b")
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:factors]
    order = order[values[order] > 1e-12 * max(values.max(), 1e-300)]
    turned = combined(span, col, [], {"k": vectors[:, order]}, "v")
    return times(t, turned, col, row, value, len(order), n_cols).withColumnRenamed("y", "f"), np.sqrt(values[order])
