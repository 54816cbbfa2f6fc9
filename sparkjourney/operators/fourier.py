"""Random Fourier features: a linear machine over them is a kernel machine.

For the Gaussian kernel exp(-gamma |x - y|^2) the mean of cos(w.x + b) cos(w.y + b)
over w ~ N(0, 2 gamma) and b uniform gives the kernel (up to a factor), so ``number``
such cosines of a row approximate its image in the kernel's space.  The weights
come from hashes of their place and the seed; they are literals of one column
expression, so no fit and no Python is needed.
"""

from __future__ import annotations

import hashlib
import math

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F


def uniform(seed: int, *place: int) -> float:
    """A number in (0, 1) that depends on the seed and the place only."""
    digest = hashlib.blake2b(repr((seed, *place)).encode(), digest_size=8).digest()
    return (int.from_bytes(digest, "big") + 0.5) / 2 ** 64


def normal(seed: int, *place: int) -> float:
    return math.sqrt(-2 * math.log(uniform(seed, *place, 1))) * math.cos(2 * math.pi * uniform(seed, *place, 2))


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Vector column -> vector of ``number`` cosines; ``gamma`` 0 means 1 / dimensions
    (the usual scale for standardised columns)."""

    dimensions = Param(Params._dummy(), "dimensions", "length of the input vector", TypeConverters.toInt)
    number = Param(Params._dummy(), "number", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the Gaussian kernel, 0 for 1 / dimensions", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, dimensions=None, number=256, gamma=0.0, seed=42):
        super().__init__()
        self._setDefault(number=256, gamma=0.0, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        d, n, seed = self.getOrDefault("dimensions"), self.getOrDefault("number"), self.getSeed()
        width = math.sqrt(2 * (self.getOrDefault("gamma") or 1 / d))
        rows = [[width * normal(seed, i, j) for j in range(d)] + [2 * math.pi * uniform(seed, i, -1)] for i in range(n)]
        weights = F.expr("array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in row) + ")" for row in rows) + ")")
        x = F.concat(vector_to_array(F.col(self.getInputCol())), F.array(F.lit(1.0)))
        dot = lambda w: F.aggregate(F.zip_with(w, F.col("_x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        scale = F.lit(math.sqrt(2 / n))
        out = dataset.withColumn("_x", x).withColumn("_f", F.transform(weights, lambda w: scale * F.cos(dot(w))))
        return out.withColumn(self.getOutputCol(), array_to_vector("_f")).drop("_x", "_f")
