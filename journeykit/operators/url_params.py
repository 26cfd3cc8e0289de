"""C5 — one row per refresh-free event and URL query parameter.

The original regroups every event by 24 keys only to rebuild the parameter
list it just unnested; since ``(session_id, event_seq_num)`` is unique per
event, that round trip is the identity, and what remains is a narrow
``explode_outer`` with two extracts: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeykit.operators.navigation import NAVIGATION_COLUMNS

# Name / value patterns applied to one "name=value" pair.
PARAM_NAME_PATTERN = r"([^=]+)"
PARAM_VALUE_PATTERN = r"[^=]+=([^&]+)"

URL_PARAM_COLUMNS = [
    "session_id", "trace_time", "page_template", "url", "traffic_source",
    "traffic_source_grouped", "traffic_medium", "page_type", "product_category",
    "product_category_full", "is_conversion", "event_seq_num", "url_lag", "url_host",
    "url_path", "prev_page_template", "next_page_template", "two_ahead_page_template",
    "entry_page_traffic_source", "last_page_template", "session_event_cnt",
    "entry_page_traffic_source_raw", "entry_page_traffic_medium",
    "param_name", "param_value",
]


def url_params(navigation: DataFrame) -> DataFrame:
    """Events without parameters keep one row with NULL name and value;
    ``+`` in a value becomes a space; no percent-decoding."""
    pair = F.col("_pair")
    exploded = navigation.select("*", F.explode_outer("param_pairs").alias("_pair"))
    # The original drops these navigation columns at this step; any column
    # the navigation step does not define (session facts attached by the
    # enrichment, internal chunk columns) is carried along.
    dropped = {"param_pairs", "device_type", "traffic_campaign", "first_page_template"}
    carried = [c for c in navigation.columns
               if c not in dropped and c not in URL_PARAM_COLUMNS and c not in NAVIGATION_COLUMNS]
    return exploded.select(
        *URL_PARAM_COLUMNS[:-2],
        F.regexp_extract(pair, PARAM_NAME_PATTERN, 1).alias("param_name"),
        F.replace(F.regexp_extract(pair, PARAM_VALUE_PATTERN, 1), F.lit("+"), F.lit(" "))
        .alias("param_value"),
        *carried,
    )
