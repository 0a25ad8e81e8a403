"""Session construction and shared-storage locations.

Jobs read the checkpoint directory from the session (``spark.checkpoint.dir``);
a private temporary directory is only created when none is configured, which is
the case in local tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins and partition counts at
# runtime from real shuffle sizes, splits skewed join partitions, and keeps
# timestamps in UTC so text round trips are reproducible.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "marketlake", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    # Local runs keep managed tables out of the working directory.
    if master.split("[")[0] == "local":
        conf.setdefault("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="marketlake-warehouse-"))
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``; only on a local master a
    temporary folder is created and registered when it is unset.
    """
    configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="marketlake-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/marketlake/{name}-{uuid.uuid4().hex}"


def cluster_conf(input_bytes: int, executors: int = 1000, cores_per_executor: int = 4,
                 target_partition_bytes: int = 256 * 1024 ** 2,
                 shuffled_bytes: int | None = None) -> dict[str, str]:
    """Settings for a large cluster, sized from the bytes a job reads.

    - Scan splits of ``target_partition_bytes`` (256 MB): a 100 TB scan becomes
      about 400 000 tasks, each small enough to stream without spilling.
    - Initial shuffle partitions: enough for ``target_partition_bytes`` per
      partition of the bytes a shuffle carries (``shuffled_bytes``, a tenth of
      the input unless given), between 2 and 10 waves of the cluster's cores;
      AQE then coalesces or splits them to the advisory size at runtime.
    - Skew join handling splits any shuffle partition over 5x the median and
      1 GB; broadcast joins only under 64 MB of measured size.
    """
    cores = executors * cores_per_executor
    shuffled = input_bytes // 10 if shuffled_bytes is None else shuffled_bytes
    shuffle = min(max(2 * cores, -(-shuffled // target_partition_bytes)), 10 * cores)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 ** 3),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
