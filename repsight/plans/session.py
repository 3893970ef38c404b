"""Session settings and the shared checkpoint folder.

Library code never creates a session of its own: every operator receives
DataFrames, and ``local_session`` exists for tests, the bench and the entry
point only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are designed around. On a cluster, raise
# ``spark.sql.shuffle.partitions`` to a few times the executor cores (AQE
# coalesces small partitions back) and keep the rest.
RECOMMENDED_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoint files are removed once the frame that wrote them is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # no Python call-site capture on every Column function: cuts plan-building round trips ~4x
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # a full analysis run compiles a few hundred distinct whole-stage classes; the default
    # cache of 100 evicts them and recompiles on every run (measured ~30 % of query time)
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "repsight",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("REPSIGHT_DRIVER_MEMORY", "8g")))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder.

    The folder the cluster names (``spark.checkpoint.dir``, or one already set
    on the context) is always used. Only a local-mode session with none set
    gets a fresh temporary folder; a cluster session without one is an error,
    since a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="repsight-ckpt-"))
    return sc.getCheckpointDir()
