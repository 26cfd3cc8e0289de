"""C3 session facts kept up shard by shard.

``session_states`` turns the flat events of some date shards into states that
merge: what a new day adds is computed from that day alone, and the facts of
all days are merged from the states without reading an event again. A session
may be in several shards, and its events may interleave in time.

A state covers a session's events of one hour, so that a session of any length
is spread over many states: counts, first and last time, the first event, flags,
counts per device, and the hour's steps in order. Paths are built per hour, and
then joined in order of the hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeykit.functions.columns import EVENT_ORDER
from journeykit.operators.sequence import null_safe_join
from journeykit.operators.sessions import PATH_SEPARATOR, ordered_path

HOUR_MS = 3_600_000


def session_states(flat: DataFrame) -> DataFrame:
    """One row per session and hour of ``flat``. Counts per device are taken
    first, so a state holds one entry for each device of its hour."""
    order = [F.col(c) for c in EVENT_ORDER]
    first = F.min(F.struct(*order, "page_template", "traffic_source_grouped", "traffic_medium", "traffic_campaign"))
    hour = F.floor(F.col("trace_time") / HOUR_MS).alias("hour")
    by_device = flat.groupBy("session_id", hour, "device_type").agg(
        F.count(F.lit(1)).alias("steps"), F.min("trace_time").alias("first_time"), F.max("trace_time").alias("last_time"),
        first.alias("first"), F.bool_or(F.col("page_template") == "ProductDetail").alias("saw_product_detail"),
        F.bool_or(F.col("is_conversion")).alias("has_conversion"),
        F.collect_list(F.struct(*order, "page_template")).alias("path"))
    return by_device.groupBy("session_id", "hour").agg(
        F.sum("steps").alias("steps"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
        F.min("first").alias("first"), F.bool_or("saw_product_detail").alias("saw_product_detail"),
        F.bool_or("has_conversion").alias("has_conversion"), F.flatten(F.collect_list("path")).alias("path"),
        F.collect_list(F.struct(F.col("device_type").alias("device"), F.col("steps").alias("n"))).alias("devices"))


def save_states(flat: DataFrame, path: str, shard: str) -> None:
    """Save the states of one shard's events under ``path``; a shard that is saved again is replaced."""
    (session_states(flat).withColumn("shard", F.lit(shard)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("shard")


def facts_from_states(states: DataFrame) -> DataFrame:
    """C3 session facts of all events that ``states`` were taken from."""
    merged = states.groupBy("session_id").agg(
        F.sum("steps").alias("journey_steps"),
        ((F.max("last_time") - F.min("first_time")) / F.lit(1000)).alias("journey_duration_seconds"),
        F.min("first").alias("first"), F.bool_or("saw_product_detail").alias("saw_product_detail"),
        F.bool_or("has_conversion").alias("has_conversion"))
    # majority of the devices, NULL a value: most frequent, then smallest, NULL first
    counts = (states.select("session_id", F.explode("devices").alias("d"))
              .groupBy("session_id", F.col("d.device").alias("device")).agg(F.sum("d.n").alias("n")))
    devices = counts.groupBy("session_id").agg(
        F.min_by("device", F.struct(-F.col("n"), F.col("device"))).alias("primary_device_type"))
    # shards that share an hour of a session interleave there
    hours = states.groupBy("session_id", "hour").agg(F.sort_array(F.flatten(F.collect_list("path"))).alias("path"))
    part = F.array_join(F.transform("path", lambda step: step["page_template"]), PATH_SEPARATOR)
    paths = (hours.select("session_id", "hour", part.alias("part")).groupBy("session_id")
             .agg(ordered_path("part", PATH_SEPARATOR, "hour").alias("journey_path")))
    facts = null_safe_join(null_safe_join(merged, devices, ["session_id"]), paths, ["session_id"])
    return facts.select(
        "session_id", "journey_path", "journey_steps", "journey_duration_seconds", "primary_device_type",
        F.col("first.page_template").alias("entry_page_template"),
        F.col("first.traffic_source_grouped").alias("traffic_source_first"),
        F.col("first.traffic_medium").alias("traffic_medium_first"),
        F.col("first.traffic_campaign").alias("traffic_campaign_first"), "saw_product_detail", "has_conversion")
