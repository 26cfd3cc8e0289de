"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from journeykit.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; what is written there is deleted
    when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the
    result has no lineage, so a lost executor recomputes nothing above it."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables up to so many rows of a few numbers each may be broadcast.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of a saved table whose counted rows allow it; beyond
    the bound the planner joins it by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def id_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Let Arrow batches of the session's Python functions hold at most ``rows``
    rows and about ``size`` bytes, so that a worker holds a few MB of documents
    at a time, however long they are."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


#: A word, and what separates words, as the contracts state them.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """A source as a key that is never null and sorts by code points, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def copy_numbers(rows: DataFrame, keys: list[str], most: int, out: str) -> DataFrame:
    """``rows`` with ``out``, long: the rows of a key that more than ``most``
    rows have are numbered from 0, all other rows have 0.

    Rows equal in ``keys`` must be interchangeable: which of them gets which
    number may differ from run to run, the numbers do not. They are numbered
    within the tasks that hold them, and shifted by the rows of the tasks
    before, so no task takes a key's rows whole. ``rows`` is read more than
    once, and so is a saved table."""
    hot = saved(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).drop("__n"), "hot-keys")
    n = hot.count()
    if not n:
        return rows.withColumn(out, F.lit(0).cast("bigint"))

    def same(other: DataFrame) -> Column:
        equal = F.lit(True)
        for k in keys:
            equal = equal & rows[k].eqNullSafe(other[k])
        return equal

    some = saved(rows.join(small_side(hot, n), same(hot), "left_semi")
                 .withColumn("__task", F.floor(F.monotonically_increasing_id() / F.lit(float(1 << 33))).cast("bigint")), "copies")
    in_task = Window.partitionBy(*keys, "__task").orderBy(F.lit(0))
    sizes = some.groupBy(*keys, "__task").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__task").alias("__of"),
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = some.withColumn("__at", F.row_number().over(in_task) - 1)
    equal = F.col("__task") == F.col("__of")
    for k in keys:
        equal = equal & F.col(k).eqNullSafe(F.col(f"__{k}"))
    numbered = at.join(shifts, equal).withColumn(out, (F.col("__at") + F.col("__before")).cast("bigint"))
    others = rows.join(small_side(hot, n), same(hot), "left_anti").withColumn(out, F.lit(0).cast("bigint"))
    return others.unionByName(numbered.select(*others.columns))
