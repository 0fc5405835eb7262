"""Spark session helpers.

Settings that matter at scale are set here once: adaptive execution (runtime
re-planning, partition coalescing, skew-join splitting), UTC session time, and
no web UI. Shuffle partitions default to the local core count for tests; on a
cluster the caller passes a number sized to the data (see README).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints written by id numbering and iterative jobs are removed once
    # their RDDs are garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Broadcast decisions are left to Spark's runtime size check; 32 MB keeps
    # the check meaningful on wide executors without risking driver memory.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


# Settings for a large cluster (about 100 TB of input, ~1000 executors).
# Shuffles start wide and AQE coalesces them to ~256 MB partitions, splits
# skewed ones, and turns small join sides into broadcasts from measured
# sizes; scans read ~512 MB splits; runtime bloom filters prune the big side
# of selective joins. Pass as ``extra`` (and a matching
# ``shuffle_partitions``) when building the session on a cluster.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "vitrina", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults."""
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or f"local[{cpus}]")
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Without the setting a session with executors of its own raises an error,
    since a machine-local folder would lose data there; a ``local`` master (one
    process, as in tests) gets a new temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="vitrina-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:  # Spark may already use the setting
        spark.sparkContext.setCheckpointDir(path)
    return path
