"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import pickle
import sys
import tempfile

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkjourney.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``).  Where none
    is set: a scratch folder of a local session, else a folder in the warehouse."""
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        fallback = os.path.join(tempfile.gettempdir(), "llm-checkpoints")
    else:
        fallback = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return ensure_checkpoint_dir(spark, fallback)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: what several later jobs read is computed once, and
    a lost executor costs no recomputation of it.  The shuffle files behind it go at once."""
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint()
    del df
    release(spark)
    return kept


#: Rows of text that go to Python at a time: a batch is held several times over (in the
#: JVM's buffers, in Arrow's, as Python strings).
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS``; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def give_back() -> None:
    """Returns freed memory to the system.  Spark reuses a Python worker for other
    operators' tasks; what the allocators keep would add up beside their own tables."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run):
    """``run`` (over a task's batches), with its memory given back at the end of the task."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are left out,
    so their names never clash with an operator's own."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


class Memo(dict):
    """A dict that fills itself from ``make`` and starts anew when its keys and values
    take ``most`` bytes, so a task's memory stays bounded on any vocabulary."""

    def __init__(self, make, most: int = 16 << 20):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        self.held += 120 + sys.getsizeof(key) + sys.getsizeof(value)
        if self.held > self.most:
            self.clear()
            self.held = 0
        self[key] = value
        return value


def in_pieces(batches, work, text_at: int = 1, most: int = 1 << 20):
    """``work`` applied to slices of the Arrow batches with about ``most`` bytes of text
    each, or one row."""
    for b in batches:
        step = max(1, most * b.num_rows // max(1, b.column(text_at).nbytes))
        for k in range(0, b.num_rows, step):
            yield work(b.slice(k, step))


def shipped(spark: SparkSession, model):
    """A function that gives the model inside tasks; it is broadcast once, pickled by value."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(data.value)


#: A set of ids is broadcast up to this many rows (about 16 MB); a larger one is joined by shuffle.
BROADCAST_IDS = 1_000_000


def _among(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    ids = cut(ids.select(F.col("doc_id").alias("_id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, docs["doc_id"] == ids["_id"], how)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``ids``; null ids stay."""
    return _among(docs, ids, "left_anti")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids``."""
    return _among(docs, ids, "left_semi")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of frames no longer
    referenced, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_batch(docs: DataFrame, change) -> DataFrame:
    """Rows kept or changed Arrow batch by Arrow batch, with the columns of ``docs``.
    ``change()`` is called once a task and gives a function of (batch, its texts)."""
    def run(batches):
        step = change()
        for b in batches:
            yield step(b, b.column(b.schema.get_field_index("text")).to_pylist())

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)
