"""C6 — session facts over refresh-free events (the sequencing view).

One row per session: a ``groupBy`` on top of the navigation step, which is
hash-partitioned by ``session_id`` already, so no new exchange; all aggregates
but the fingerprint merge map-side. ``with_session_facts`` puts the same values
on every event instead, by windows over the navigation step's own partitioning
and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeykit.functions.columns import first_by_order, majority_value
from journeykit.operators.sequence import null_safe_join
from journeykit.operators.sessions import chunked_path, hot_majority, ordered_path

STEP_SEPARATOR = " > "
FIRST_STEPS = 5
BY_TIME = ("trace_time", "event_seq_num")

SEQUENCE_FACT_COLUMNS = [
    "session_id", "event_cnt", "journey_fingerprint_str",
    "journey_fingerprint_first_five_str", "entry_page_template",
    "entry_page_traffic_source_session_lvl", "entry_page_source", "entry_page_medium",
    "primary_device_type", "primary_traffic_source", "saw_product_detail",
    "had_conversion", "conversion_cnt",
]


def refresh_free(navigation: DataFrame) -> DataFrame:
    # Always true after refresh removal; kept as the documented predicate.
    return navigation.filter(~(F.col("url_lag") == F.col("url")))


def _facts(fingerprint: Column, cold: Column | None) -> dict[str, Column]:
    """Fact aggregates by name; the majorities count the rows that are ``cold``."""
    return {
        "event_cnt": F.count(F.lit(1)),
        "journey_fingerprint_str": fingerprint,
        "entry_page_template": first_by_order("page_template", *BY_TIME),
        "entry_page_traffic_source_session_lvl": first_by_order("entry_page_traffic_source_raw", *BY_TIME),
        "entry_page_source": first_by_order("traffic_source", *BY_TIME),
        "entry_page_medium": first_by_order("traffic_medium", *BY_TIME),
        "primary_device_type": majority_value("device_type", where=cold),
        "primary_traffic_source": majority_value("traffic_source_grouped", where=cold),
        "saw_product_detail": F.bool_or(F.lower("page_template") == "productdetail"),
        "had_conversion": F.bool_or(F.col("is_conversion")),
        "conversion_cnt": F.sum(F.when(F.col("is_conversion"), 1).otherwise(0)).cast("bigint"),
    }


def _first_five(fingerprint: Column) -> Column:
    # Page templates never contain the separator, so the first five steps are
    # the first five tokens of the full fingerprint: no second collection.
    return F.array_join(F.slice(F.split(fingerprint, STEP_SEPARATOR), 1, FIRST_STEPS), STEP_SEPARATOR)


def sequence_session_facts(navigation: DataFrame) -> DataFrame:
    """Per session: event count, journey fingerprint (all steps and the first
    five), entry page / source / medium, majority device and grouped source,
    product-detail and conversion flags, conversion count.

    When ``navigation`` carries chunk columns with hot sessions, their
    fingerprint is built per chunk and their majorities from counts per value
    (see ``sessions.chunked_path`` and ``sessions.hot_majority``)."""
    steps = refresh_free(navigation)
    hot = "_hot" in navigation.columns
    value, cold = "page_template", None
    if hot:
        cold = ~F.col("_hot")
        steps = steps.withColumn("_path_value", F.when(cold, F.col("page_template")))
        value = "_path_value"
    fingerprint = ordered_path(value, STEP_SEPARATOR, "event_seq_num")
    facts = steps.groupBy("session_id").agg(*[c.alias(n) for n, c in _facts(fingerprint, cold).items()])
    if hot:
        key = ["session_id"]
        found = chunked_path(steps, "page_template", STEP_SEPARATOR, ("event_seq_num",), "_hot_path")
        for name, column in (("_hot_device", "device_type"), ("_hot_source", "traffic_source_grouped")):
            found = null_safe_join(found, hot_majority(steps, column, name), key)
        facts = null_safe_join(facts, found.withColumn("_is_hot", F.lit(True)), key, "left")
        for name, column in (("journey_fingerprint_str", "_hot_path"), ("primary_device_type", "_hot_device"),
                             ("primary_traffic_source", "_hot_source")):
            facts = facts.withColumn(name, F.when(F.col("_is_hot"), F.col(column)).otherwise(F.col(name)))
    return (facts.withColumn("journey_fingerprint_first_five_str", _first_five(F.col("journey_fingerprint_str")))
            .select(*SEQUENCE_FACT_COLUMNS))


def with_session_facts(navigation: DataFrame, facts: list[str]) -> DataFrame:
    """Every event with ``facts`` of its session (NULL where its id is NULL).

    A window over the whole session has its value once per session and reads
    the events in the order in which the navigation step left them, so neither
    an exchange nor a sort is added, and no join. For sessions that fit one
    task; ``enrich`` joins the facts of hot ones."""
    order = ("trace_time", "_hit") if "_hit" in navigation.columns else ("event_seq_num",)
    session = Window.partitionBy("session_id")
    ordered = session.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def first(column: str) -> Column:
        return F.first(column).over(ordered)

    fingerprint = F.listagg("page_template", F.lit(STEP_SEPARATOR)).over(ordered)
    values = {
        "event_cnt": F.count(F.lit(1)).over(ordered),
        "journey_fingerprint_str": fingerprint,
        "entry_page_template": first("page_template"),
        "entry_page_traffic_source_session_lvl": first("entry_page_traffic_source_raw"),
        "entry_page_source": first("traffic_source"),
        "entry_page_medium": first("traffic_medium"),
        "primary_device_type": majority_value("device_type", ordered),
        "primary_traffic_source": majority_value("traffic_source_grouped", ordered),
        "saw_product_detail": F.bool_or(F.lower("page_template") == "productdetail").over(ordered),
        "had_conversion": F.bool_or(F.col("is_conversion")).over(ordered),
        "conversion_cnt": F.sum(F.when(F.col("is_conversion"), 1).otherwise(0)).over(ordered).cast("bigint"),
    }
    steps = refresh_free(navigation)
    out = steps.select("*", *[c.alias(n) for n, c in values.items()])
    out = out.withColumn("journey_fingerprint_first_five_str", _first_five(F.col("journey_fingerprint_str")))
    known = F.col("session_id").isNotNull()
    return out.select(*steps.columns, *[F.when(known, F.col(n)).alias(n) for n in facts])
