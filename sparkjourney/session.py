"""Session helpers: a sane local/cluster session and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sparkjourney", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    * AQE on (runtime coalescing, skew-join splitting, broadcast conversion).
    * Session time zone pinned to UTC: all event times are TIMESTAMP_NTZ, so
      no operator depends on it, but string rendering stays stable.
    * UI off: no server is started.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # checkpoint files of materialized tables go away with their DataFrames
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Point the SparkContext at the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``; ``fallback`` is only used
    when that setting is absent (tests pass a scratch folder).  Returns the
    folder in use, or None when neither is available.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    d = d or fallback
    if d:
        sc.setCheckpointDir(d)
    return d


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints.  A local session without one gets a
    scratch folder; on a cluster ``spark.checkpoint.dir`` must be set."""
    master = spark.sparkContext.master
    local = master.startswith("local") and not master.startswith("local-cluster")
    found = ensure_checkpoint_dir(spark) or (local and ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="sparkjourney-")))
    if not found:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a DataFrame that several jobs reuse.

    A reliable ``checkpoint()`` into the shared checkpoint folder, so a
    lost executor does not force recomputation of the whole upstream plan.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
