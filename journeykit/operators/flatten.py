"""C1 — nested visits → one row per page / transaction hit (20 columns).

Narrow transformation: no shuffle. The hit-type filter runs on the array
before ``explode`` so only kept hits are generated, and the date range is a
plain filter on the partition column (a partition filter on a file source).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from journeykit.functions.rules import page_template, source_group

# Hit types kept, conversion action code, category pattern.
KEPT_HIT_TYPES = ["PAGE", "TRANSACTION"]
PURCHASE_ACTION = "6"
CONVERSION_HIT_TYPE = "TRANSACTION"
TOP_CATEGORY_PATTERN = r"^Home/([^/]+)"

FLAT_COLUMNS = [
    "session_id", "trace_time", "event_seq_num", "url_path", "url_host", "url",
    "device_type", "page_type", "page_template", "traffic_source", "traffic_medium",
    "traffic_campaign", "traffic_ad_content", "traffic_keyword", "gclid",
    "traffic_source_grouped", "product_category", "product_category_full",
    "ecommerce_action_type", "is_conversion",
]


def session_id() -> Column:
    """The session id of a visit, NULL if one of its parts is."""
    return F.concat(F.col("fullVisitorId"), F.lit("-"), F.col("visitId").cast("string"))


def kept_hits(hit_filter: Callable[[Column], Column] | None = None) -> Column:
    """The hits of a visit that become events (and satisfy ``hit_filter``)."""
    def keep(h: Column) -> Column:
        cond = h["type"].isin(*KEPT_HIT_TYPES)
        return cond if hit_filter is None else cond & hit_filter(h)

    return F.filter("hits", keep)


def preprocess_hits(sessions: DataFrame, date_from: str | None = None,
                    date_to: str | None = None,
                    hit_filter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Flatten nested visits into classified page-view events.

    ``date_from``/``date_to`` are inclusive ``yyyymmdd`` strings compared as
    strings, like the source's daily shard names. ``hit_filter`` (a predicate
    on one hit struct) is applied inside the array together with the hit-type
    filter, so an analysis that only needs some hits never generates the
    others — Catalyst cannot move a filter on generated rows below ``explode``.
    """
    df = sessions
    if date_from is not None:
        df = df.filter(F.col("date") >= F.lit(date_from))
    if date_to is not None:
        df = df.filter(F.col("date") <= F.lit(date_to))

    kept = kept_hits(hit_filter)
    source = F.col("trafficSource.source")
    # Visit-level columns (session id, grouped source, ...) are computed once
    # per visit row in their own projection, before the hits are generated:
    # in one select with ``explode`` the analyzer would evaluate them per hit.
    df = df.select(
        session_id().alias("_session_id"),
        (F.col("visitStartTime") * 1000).alias("_start_ms"),
        F.col("device.deviceCategory").alias("_device_type"),
        source.alias("_source"),
        F.col("trafficSource.medium").alias("_medium"),
        F.col("trafficSource.campaign").alias("_campaign"),
        F.col("trafficSource.adContent").alias("_ad_content"),
        F.col("trafficSource.keyword").alias("_keyword"),
        F.col("trafficSource.adwordsClickInfo.gclid").alias("_gclid"),
        source_group(source).alias("_source_grouped"),
        kept.alias("_kept"),
    )
    visit_cols = [c for c in df.columns if c != "_kept"]
    df = df.select(*visit_cols, F.explode("_kept").alias("h"))

    path = F.col("h.page.pagePath")
    host = F.col("h.page.hostname")
    first_category = F.get(F.col("h.product"), 0)["v2ProductCategory"]
    action = F.col("h.eCommerceAction.action_type")
    hit_type = F.col("h.type")

    return df.select(
        F.col("_session_id").alias("session_id"),
        (F.col("_start_ms") + F.col("h.time")).alias("trace_time"),
        F.col("h.hitNumber").alias("event_seq_num"),
        path.alias("url_path"),
        host.alias("url_host"),
        F.concat(F.lit("https://"), host, path).alias("url"),
        F.col("_device_type").alias("device_type"),
        hit_type.alias("page_type"),
        page_template(path).alias("page_template"),
        F.col("_source").alias("traffic_source"),
        F.col("_medium").alias("traffic_medium"),
        F.col("_campaign").alias("traffic_campaign"),
        F.col("_ad_content").alias("traffic_ad_content"),
        F.col("_keyword").alias("traffic_keyword"),
        F.col("_gclid").alias("gclid"),
        F.col("_source_grouped").alias("traffic_source_grouped"),
        F.nullif(F.regexp_extract(first_category, TOP_CATEGORY_PATTERN, 1), F.lit("")).alias("product_category"),
        first_category.alias("product_category_full"),
        action.alias("ecommerce_action_type"),
        F.when(action == PURCHASE_ACTION, True)
        .when(hit_type == CONVERSION_HIT_TYPE, True)
        .otherwise(False).alias("is_conversion"),
    )
