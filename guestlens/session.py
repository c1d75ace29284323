"""Session settings: adaptive plans on, nothing sized for one machine unless the caller asks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "guestlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session for jobs and tests.

    The number of shuffle partitions, memory and the master are the cluster's business; pass
    ``master`` and ``conf`` for local runs.  Adaptive execution coalesces small partitions and
    splits skewed join partitions.  Checkpoint files go when nothing refers to them any more.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_checkpoints(spark: SparkSession) -> str:
    """The shared checkpoint folder: the context's, else the one that ``spark.checkpoint.dir`` names.

    Where neither is set, as in a bare local session, the folder lies in the warehouse, which driver and
    executors share as well.  There is no temporary folder.
    """
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()
