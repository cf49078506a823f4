"""Session construction and cluster-level settings."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every session of the engine should carry.  Timestamps in the
# input files are wall-clock (timestamp_ntz); the UTC zone keeps the few
# casts to timestamp (watermarks) free of daylight-saving gaps.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


MB = 1 << 20


def sizing(input_bytes: int, cores: int, *, target_partition_bytes: int = 256 * MB) -> dict:
    """Partition settings for a job reading ``input_bytes`` on ``cores``
    executor cores.

    Scans split files into ~``target_partition_bytes`` pieces; shuffles
    start with enough partitions that each holds about that much (at least
    two waves of tasks), and AQE merges small ones and splits skewed ones
    around the same size.  At 100 TB on 8,000 cores this gives about
    400k shuffle partitions of 256 MB, each comfortably inside an
    executor's memory; at test scale it falls back to two per core.
    """
    parts = max(2 * cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false" if input_bytes > 64 * target_partition_bytes else "true",
    }


def get_session(master: str | None = None, app: str = "tidewater",
                shuffle_partitions: int | None = None,
                extra: dict | None = None, *, input_bytes: int | None = None,
                cores: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's settings.

    Without ``master`` the submit environment decides (plain Python runs
    local).  Give ``input_bytes`` (and ``cores``) to size partitions to the
    data (see :func:`sizing`), or ``shuffle_partitions`` directly.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if input_bytes is not None:
        conf.update(sizing(input_bytes, cores or os.cpu_count() or 8))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if os.environ.get("SPARK_DRIVER_MEMORY"):
        conf["spark.driver.memory"] = os.environ["SPARK_DRIVER_MEMORY"]
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Apply the SQL settings that can change on a live session."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, taken from ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment to shared storage; it is
    an error if it is not.  Only a local session gets a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tidewater-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)   # for DataFrame.checkpoint()
    return d


def apply_sizing(spark: SparkSession, *paths: str) -> dict:
    """Size the session's partitions to the bytes under ``paths`` (the job's
    inputs) and the cluster's cores; returns the settings applied."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            total += fs.getContentSummary(path).getLength()
    out = sizing(total, spark.sparkContext.defaultParallelism)
    for k, v in out.items():
        spark.conf.set(k, v)
    return out


SPREAD_BYTES = 8 * MB
MERGE_BYTES = 16 * MB


def spread_shuffles(spark: SparkSession, folder: str) -> int:
    """Start shuffles with a partition per SPREAD_BYTES of the input files
    under ``folder``, ``spark.sql.shuffle.partitions`` at least, and leave it
    to AQE to merge the small ones up to MERGE_BYTES, which are compressed
    and several times that in a sort or a hash map: what one task holds does
    not grow with the input.  State stores keep ``spark.sql.shuffle.partitions``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(path).getLength() if fs.exists(path) else 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SPREAD_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(MERGE_BYTES))
    return parts
