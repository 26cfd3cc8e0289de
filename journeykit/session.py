"""Spark session helpers shared by tests, bench and the driver entry."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "journeykit") -> SparkSession:
    """A local session with the settings the queries assume.

    AQE stays on: it coalesces small shuffle partitions at runtime and splits
    skewed join partitions. The UI is off (no server is opened).
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared filesystem folder and is used as
    is. Only when it is unset (local tests and bench) a scratch folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="journeykit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


ROWS_PER_CHUNK_CONF = "journeykit.rowsPerChunk"


def rows_per_chunk(spark: SparkSession, default: int = 1_000_000) -> int:
    """Rows per window chunk: groups larger than this are split (see
    ``operators.sequence``). Read from the session setting
    ``journeykit.rowsPerChunk``."""
    value = spark.conf.get(ROWS_PER_CHUNK_CONF, None)
    return int(value) if value else default
