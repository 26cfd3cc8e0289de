"""C2 first touch and C3 session facts over flat events.

C3 is one ``groupBy(session_id)``: every aggregate in it merges map-side
(count, min/max, ``min_by``, ``bool_or``, ``mode``), so a hot session is
pre-aggregated before the shuffle; only the ordered path string has to see
every step of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeykit.functions.columns import EVENT_ORDER, first_by_order, majority_value
from journeykit.operators.sequence import ChunkPlan, no_chunks, null_safe_join, ordered_context, with_chunks

PATH_SEPARATOR = " -> "


def first_touch(flat: DataFrame, plan: ChunkPlan | None = None) -> DataFrame:
    """C2: every event plus the session's first grouped source, medium and
    campaign (first in time, hit number breaking ties) — the running first
    value is the session's first value on every row."""
    plan = plan if plan is not None else no_chunks(["session_id"], list(EVENT_ORDER))
    return ordered_context(flat, plan, firsts=[
        ("traffic_source_first", "traffic_source_grouped"),
        ("traffic_medium_first", "traffic_medium"),
        ("traffic_campaign_first", "traffic_campaign"),
    ])


def ordered_path(value: str, separator: str, *order: str) -> F.Column:
    """String of ``value`` over the group in ``order`` (NULLs skipped)."""
    keys = ", ".join(order or EVENT_ORDER)
    return F.expr(f"listagg({value}, '{separator}') WITHIN GROUP (ORDER BY {keys})")


def chunked_path(rows: DataFrame, value: str, separator: str, order: tuple[str, ...],
                 name: str) -> DataFrame:
    """Ordered path string of hot groups built in two levels: one partial
    string per (session, chunk) — chunks are bounded and spread over tasks —
    then the partial strings joined in chunk order. Only a bounded number of
    parts per session ever meets in one buffer."""
    parts = (rows.filter(F.col("_hot")).groupBy("session_id", "_chunk")
             .agg(ordered_path(value, separator, *order).alias("_part")))
    return parts.groupBy("session_id").agg(ordered_path("_part", separator, "_chunk").alias(name))


def hot_majority(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Most frequent ``value`` of hot sessions from its counts (NULL is a
    value; ties go to the smallest, NULL first): a session's values are spread
    over tasks, and no buffer holds a map of them."""
    counts = rows.filter(F.col("_hot")).groupBy("session_id", value).agg(F.count(F.lit(1)).alias("_times"))
    order = F.struct(-F.col("_times"), F.col(value))
    return counts.groupBy("session_id").agg(F.min_by(F.col(value), order).alias(name))


def session_facts(flat: DataFrame, with_duration_ms: bool = False,
                  plan: ChunkPlan | None = None, with_path: bool = True) -> DataFrame:
    """C3: one row per session with path, steps, duration, device, entry
    page, first-touch source/medium/campaign and behaviour flags.

    First touch (C2) is folded in as ``min_by`` on the event order: the same
    value the first-value window gives on every row, without a window.
    ``with_duration_ms`` adds the integer duration used for exact averages.
    With hot sessions in ``plan`` their path is built per chunk and their
    device from counts first. All other facts merge map-side, so without the
    path (``with_path=False``) no session needs a plan."""
    hot = plan is not None and plan.active
    rows = flat
    path_value, cold = "page_template", None
    if hot:
        # hot sessions are left out of the one-level path and majority (NULLs are skipped)
        cold = ~F.col("_hot")
        rows = with_chunks(flat, plan).withColumn("_path_value", F.when(cold, F.col("page_template")))
        path_value = "_path_value"
    duration_ms = F.max("trace_time") - F.min("trace_time")
    cols = [ordered_path(path_value, PATH_SEPARATOR).alias("journey_path")] if with_path else []
    cols += [
        F.count(F.lit(1)).alias("journey_steps"),
        (duration_ms / F.lit(1000)).alias("journey_duration_seconds"),
        majority_value("device_type", where=cold).alias("primary_device_type"),
        first_by_order("page_template").alias("entry_page_template"),
        first_by_order("traffic_source_grouped").alias("traffic_source_first"),
        first_by_order("traffic_medium").alias("traffic_medium_first"),
        first_by_order("traffic_campaign").alias("traffic_campaign_first"),
        F.bool_or(F.col("page_template") == "ProductDetail").alias("saw_product_detail"),
        F.bool_or(F.col("is_conversion")).alias("has_conversion"),
    ]
    if with_duration_ms:
        cols.append(duration_ms.alias("journey_duration_ms"))
    facts = rows.groupBy("session_id").agg(*cols)
    if not hot:
        return facts
    # Hot paths are few but long: joined on the session key (NULL is one), not broadcast.
    key = ["session_id"]
    found = hot_majority(rows, "device_type", "_hot_device").withColumn("_is_hot", F.lit(True))
    instead = {"primary_device_type": "_hot_device"}
    if with_path:
        found = null_safe_join(found, chunked_path(rows, "page_template", PATH_SEPARATOR, EVENT_ORDER, "_hot_path"), key)
        instead["journey_path"] = "_hot_path"
    out = null_safe_join(facts, found, key, "left")
    return out.select(*[F.when(F.col("_is_hot"), F.col(instead[c])).otherwise(F.col(c)).alias(c) if c in instead else c
                        for c in facts.columns])
