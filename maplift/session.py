"""Spark session and shared-folder helpers.

Everything in the library takes a ``SparkSession`` and returns lazy
DataFrames; this module only builds a session for tests/bench and finds
the shared folder used for staging writes and lineage cuts.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings tuned for large inputs: AQE re-plans joins and coalesces
# partitions at runtime, skew-join splits hot join keys, and the automatic
# broadcast threshold is a size-checked broadcast (Spark falls back to a
# sort-merge join above it).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "maplift") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("MAPLIFT_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_session_conf(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Runtime SQL settings the operators rely on (safe on an existing session)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    On a cluster this setting must name shared storage.  Only a local master, whose
    tasks all run on this machine, gets a scratch folder when it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        d = d or spark.sparkContext.getCheckpointDir()
        master = spark.sparkContext.master
    except Exception as e:  # pragma: no cover - connect sessions have no SparkContext
        if not d:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from e
        return d.rstrip("/")
    if not d:
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="maplift-ckpt-", dir=os.environ.get("MAPLIFT_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never-reused path under the shared folder (staging, versions)."""
    return f"{shared_dir(spark)}/{name}/v-{uuid.uuid4().hex[:12]}"
