"""Session sizes of the date shards, saved beside them.

Ordered per-session steps must know which sessions are too large for one task.
Instead of counting the events again for every query, each shard's sessions are
counted once, from the visits' hit types alone, and the counts of several
shards are merged. A shard lists its sessions of at least ``floor`` events and
the largest count below that, so the manifest is small. The merged counts are
upper bounds: a session is not listed by a shard that has fewer than ``floor``
of its events. That is enough, as cutting a session into chunks that did not
need it changes no result.

A shard's rows carry the bytes and files that they were counted from. A shard
that was written again, or is missing, is noticed, and the sizes are unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeykit.operators.flatten import kept_hits, session_id

#: Folder of the manifest under that of the shards (a leading underscore: not data).
FOLDER = "_session_sizes"
DEFAULT_FLOOR = 1000
DDL = "session_id STRING, n BIGINT, is_rest BOOLEAN, bytes BIGINT, files BIGINT, shard STRING"


def shard_states(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """(bytes, files) of every date shard under ``path``, from the folder listing."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    states = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("date="):
            summary = fs.getContentSummary(status.getPath())
            states[name.removeprefix("date=")] = (summary.getLength(), summary.getFileCount())
    return states


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest rows of the shards under ``path``; none if there is no manifest."""
    where = f"{path.rstrip('/')}/{FOLDER}"
    if not _exists(spark, where):
        return spark.createDataFrame([], DDL)
    return spark.read.schema(DDL).parquet(where)


def recorded_states(manifest: DataFrame) -> dict[str, tuple[int, int]]:
    """(bytes, files) that each shard was counted from: one row per shard."""
    rows = manifest.where("is_rest").select("shard", "bytes", "files").collect()
    return {r["shard"]: (r["bytes"], r["files"]) for r in rows}


def update_manifest(spark: SparkSession, path: str, visits: DataFrame, floor: int = DEFAULT_FLOOR) -> list[str]:
    """Count the sessions of the shards that are new or changed; ``visits``
    reads the shards under ``path``. Returns the shards that were counted."""
    states, known = shard_states(spark, path), recorded_states(read_manifest(spark, path))
    changed = sorted(s for s, state in states.items() if known.get(s) != state)
    if not changed:
        return []
    sizes = (visits.where(F.col("date").isin(changed))
             .select(F.col("date").cast("string").alias("shard"), session_id().alias("session_id"),
                     F.size(kept_hits()).alias("n"))
             .groupBy("shard", "session_id").agg(F.sum("n").cast("bigint").alias("n")))
    # Sessions below the floor share one row, with the largest of their counts.
    listed = F.col("n") >= floor
    rows = (sizes.groupBy("shard", (~listed).alias("is_rest"), F.when(listed, F.struct("session_id")).alias("key"))
            .agg(F.max("n").alias("n")))
    told = rows.select("shard", F.col("key.session_id").alias("session_id"), "n", "is_rest")
    # Every shard has a row of its rest, also if that is empty.
    stated = spark.createDataFrame([(s, *states[s]) for s in changed], "shard STRING, bytes BIGINT, files BIGINT")
    empty = stated.select("shard", F.lit(None).cast("string").alias("session_id"), F.lit(0).cast("bigint").alias("n"),
                          F.lit(True).alias("is_rest"))
    whole = (told.unionByName(empty).groupBy("shard", "session_id", "is_rest").agg(F.max("n").alias("n"))
             .join(F.broadcast(stated), "shard"))
    (whole.select("session_id", "n", "is_rest", "bytes", "files", "shard").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path.rstrip('/')}/{FOLDER}"))
    return changed


def session_sizes(spark: SparkSession, path: str, date_from: str | None, date_to: str | None,
                  limit: int) -> DataFrame | None:
    """``session_id, _n`` (an upper bound) that hold every session of more than
    ``limit`` events in the shards from ``date_from`` to ``date_to``; None if
    the manifest cannot tell."""
    def wanted(shard: str) -> bool:
        return (date_from is None or shard >= date_from) and (date_to is None or shard <= date_to)

    states = {s: state for s, state in shard_states(spark, path).items() if wanted(s)}
    manifest = read_manifest(spark, path)
    known = recorded_states(manifest)
    if any(known.get(s) != state for s, state in states.items()):
        return None
    rows = manifest.where(F.col("shard").isin(list(states)))
    rest = rows.where("is_rest").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if rest > limit:
        return None
    return (rows.where("not is_rest").groupBy("session_id").agg((F.sum("n") + rest).alias("_n"))
            .where(F.col("_n") > limit))
