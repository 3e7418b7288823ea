"""Session settings shared by the bench, the tests and user programs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_spark(app_name: str = "tabgauge", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on and UTC time.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit settings
    then decide. ``shuffle_partitions`` is a ceiling there, since adaptive execution
    merges small partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting it only where the session has none.

    The shared folder comes from ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder; a cluster without the setting is an error, because a
    machine-local folder does not outlive its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tabgauge-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()
