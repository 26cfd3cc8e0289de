"""Flat event table: where it is read from and how it is saved.

Saving the flat events bucketed (and sorted) by ``session_id`` is what makes
every later per-session step — windows, session aggregates and the facts
join — run without an exchange: the scan already delivers the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from journeykit.operators.sequence import ChunkPlan, with_chunks

DEFAULT_BUCKETS = 64


def read_table(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """Accept a DataFrame, a catalog table name or a Parquet path."""
    if isinstance(source, DataFrame):
        return source
    if "/" in source:
        return spark.read.parquet(source)
    return spark.table(source)


def write_by_session(rows: DataFrame, table: str, buckets: int = DEFAULT_BUCKETS,
                     path: str | None = None, mode: str = "overwrite") -> None:
    """Save flat events, or the navigation step, as a table bucketed by ``session_id``.

    The rows are dealt by the bucket key first, so each bucket is one task's
    and at most ``buckets`` files are written, whatever the number of input
    tasks. A hot session is one bucket's, as bucketing defines it;
    ``write_split_by_session`` keeps hot sessions apart.
    ``buckets`` should grow with the data (about one bucket per 256 MB of
    compressed events); ``path`` places the table in a shared folder."""
    writer = (rows.repartition(buckets, "session_id").write.mode(mode).format("parquet")
              .bucketBy(buckets, "session_id").sortBy("session_id", "trace_time", "event_seq_num"))
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


write_flat_events = write_by_session


def hot_table(table: str) -> str:
    return f"{table}_hot"


def write_split_by_session(flat: DataFrame, table: str, plan: ChunkPlan, buckets: int = DEFAULT_BUCKETS,
                           path: str | None = None) -> None:
    """Save flat events as two tables: ``table``, bucketed by ``session_id``,
    and ``hot_table(table)`` with the rows of the sessions that ``plan`` found
    too large for one task (the NULL session may be one), bucketed by session
    and chunk, so that one session is written and read by many tasks.

    A session is in one of them whole, in the first only if it fits one task:
    reading them needs no size pass. The second is empty without hot sessions."""
    marked = with_chunks(flat, plan)
    write_by_session(marked.where("not _hot").drop("_hot", "_chunk"), table, buckets, path)
    key = ["session_id", "_chunk"]
    writer = (marked.where("_hot").drop("_hot").repartition(buckets, *key).write.mode("overwrite").format("parquet")
              .bucketBy(buckets, *key).sortBy(*key, "trace_time", "event_seq_num"))
    if path is not None:
        writer = writer.option("path", f"{path.rstrip('/')}_hot")
    writer.saveAsTable(hot_table(table))
