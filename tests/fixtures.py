"""Hand-written inputs at the flat-event level (FIXTURES.md §5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeykit.functions.rules import page_template, source_group
from journeykit.operators.flatten import FLAT_COLUMNS

FLAT_DDL = (
    "session_id STRING, trace_time BIGINT, event_seq_num BIGINT, url_path STRING, "
    "device_type STRING, traffic_source STRING, traffic_medium STRING, is_conversion BOOLEAN"
)

EDGE_ROWS = [
    ("E1", 1000, 1, "/home", "mobile", "google", "organic", False),
    ("E1", 2000, 2, "/home", "mobile", "google", "organic", False),
    ("E1", 3000, 3, "/a/b/c?x=1&y=2+3", "mobile", "google", "organic", False),
    ("E1", 4000, 4, None, "mobile", "google", "organic", False),
    ("E1", 5000, 5, "/a/b", "mobile", "google", "organic", False),
    ("E1", 6000, 6, "/basket.html", "mobile", "google", "organic", True),
    ("E2", 1000, 2, "/basket.html", "desktop", None, None, False),
    ("E2", 1000, 1, "/", "mobile", None, None, False),
    ("E3", 1000, 1, "/a", None, "t.co", "referral", False),
    ("E3", 2000, 2, "/a/b", None, "t.co", "referral", False),
    ("E3", 3000, 3, "/", "desktop", "t.co", "referral", False),
]


def flat_from_rows(spark: SparkSession, rows=EDGE_ROWS, host: str = "h") -> DataFrame:
    """Flat events with the 20 columns of the flattening output."""
    df = spark.createDataFrame(rows, FLAT_DDL)
    path = F.col("url_path")
    full = df.select(
        "session_id", "trace_time", "event_seq_num", "url_path",
        F.lit(host).alias("url_host"),
        F.concat(F.lit("https://"), F.lit(host), path).alias("url"),
        "device_type",
        F.lit("PAGE").alias("page_type"),
        page_template(path).alias("page_template"),
        "traffic_source", "traffic_medium",
        F.lit(None).cast("string").alias("traffic_campaign"),
        F.lit(None).cast("string").alias("traffic_ad_content"),
        F.lit(None).cast("string").alias("traffic_keyword"),
        F.lit(None).cast("string").alias("gclid"),
        source_group(F.col("traffic_source")).alias("traffic_source_grouped"),
        F.when(page_template(path) == "ProductDetail", F.lit("Apparel")).alias("product_category"),
        F.lit(None).cast("string").alias("product_category_full"),
        F.lit("0").alias("ecommerce_action_type"),
        "is_conversion",
    )
    return full.select(*FLAT_COLUMNS)
