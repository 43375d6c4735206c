"""Session settings the jobs rely on, and the shared checkpoint folder.

All jobs are plain ``DataFrame -> DataFrame`` functions and work on any
session; these settings only make the written layout and timestamps right.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the package assumes (see README "Session").
RECOMMENDED_CONF = {
    # Readings are UTC ("GMT") instants.
    "spark.sql.session.timeZone": "UTC",
    # INT96 carries no min/max statistics; micros lets sorted month files
    # skip row groups on time predicates.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Month updates replace only the months they touch.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    # Nanosecond Parquet times are read as longs (scan_nanos); others are not affected.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    # Checkpointed tables go with the frames that read them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", app_name: str = "pvtide",
                  shuffle_partitions: int = 8, extra: dict | None = None,
                  scratch: str | None = None, driver_memory: str = "4g") -> SparkSession:
    """A session with the recommended settings (tests, bench, local runs).

    ``scratch``: the folder for intermediate tables (on a cluster one that
    all executors share), unless ``spark.checkpoint.dir`` is set already.
    """
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", driver_memory))
    for key, value in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, scratch)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, scratch: str | None = None) -> str:
    """Return the reliable checkpoint folder of this session.

    The folder comes from ``spark.checkpoint.dir`` (on a cluster a shared
    file system every executor sees), else from ``scratch``. Only a session
    of one process (``local[n]``) without either gets a fresh folder of its
    own, as in tests.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no driver context; the server reads the setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if scratch:
        sc.setCheckpointDir(scratch)
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder: jobs that cut lineage "
            "write their intermediate tables there")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pvtide-ckpt-"))
    return sc.getCheckpointDir()
