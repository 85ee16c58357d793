"""SparkSession settings shared by tests, bench and the driver entry."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session zone (all timestamps are stored as
# UTC wall time), ANSI on (bad casts raise unless try_* is used), AQE with
# partition coalescing and skew-join splitting, and runtime bloom filters so a
# selective semi-join prunes the big side before its shuffle.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of texts is held by the JVM and by a Python worker at the same time, in several copies
    # each: 8 MB, in place of Spark's 64 MB, bound them by their bytes, whatever the length of a text.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # HotSpot never compiles a method of over 8000 bytes of bytecode: a stage that would
    # be one (the record normalisers) runs as separate, compiled projections instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "vitrine", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("VITRINE_DRIVER_MEMORY", "8g")))
    for k, v in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session (e.g. the driver's)."""
    for k, v in SESSION_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave it as the owner set it
            pass
    return spark


def bounded_batches(spark: SparkSession) -> None:
    """Of the session settings only the one that bounds what tasks hand to Python at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, SESSION_CONF[key])


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared lineage-cut folder: the cluster's ``spark.checkpoint.dir``.

    Where the session names none, a scratch folder is made and registered in a
    single process only (``local[...]``, as in tests); on a cluster that is an
    error, since each machine would write to its own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        d = tempfile.mkdtemp(prefix="vitrine-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def cluster_settings(input_bytes: int, executor_cores: int, executors: int,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Spill-aware sizing for a big run (e.g. 100 TB on 1000 executors).

    * scan splits of ``target_partition_bytes`` (Parquet row groups permitting);
    * initial shuffle partitions = input / target, at least 2 waves of cores, so
      the largest shuffle's partitions fit in a task's memory share; AQE then
      coalesces small ones to the advisory size and splits skewed ones;
    * broadcast only under Spark's size check (kept at its default).
    """
    cores = max(1, executor_cores * executors)
    parts = max(2 * cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    }
