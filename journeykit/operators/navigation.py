"""C4 — navigation context per event, then removal of page refreshes.

All window values share one order (time, then raw hit number) per session,
so Spark plans one exchange and one sort for the whole step; sessions above
the chunk threshold are windowed in ordered chunks and repaired at chunk
edges (``sequence.ordered_context``). The refresh filter is applied last:
every window value still sees the refresh rows, as the original evaluation
order requires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeykit.operators.sequence import ChunkPlan, ordered_context, session_plan

# Placeholder for a missing neighbour, URL parameter pattern.
MISSING = "N/A"
PARAM_PAIR_PATTERN = r"[?&]((?:[^=]+)=(?:[^&]+))"

NAVIGATION_COLUMNS = [
    "session_id", "trace_time", "page_template", "url", "traffic_source",
    "traffic_source_grouped", "traffic_medium", "traffic_campaign",
    "entry_page_traffic_source", "device_type", "page_type", "product_category",
    "product_category_full", "is_conversion", "event_seq_num", "url_lag",
    "prev_page_template", "next_page_template", "two_ahead_page_template",
    "first_page_template", "last_page_template", "session_event_cnt", "url_host",
    "url_path", "param_pairs", "entry_page_traffic_source_raw",
    "entry_page_traffic_medium",
]


def navigation_context(flat: DataFrame, plan: ChunkPlan | None = None,
                       keep_chunk: bool = False, keep_hit: bool = False) -> DataFrame:
    """Per-event navigation context on refresh-free events.

    ``event_seq_num`` is replaced by the 1-based position in the session
    (refreshes counted); ``two_ahead_page_template`` is two steps back. An
    event is dropped when its URL equals the previous one, or when either URL
    is NULL (NULL comparison), but not when it is the first of its session.
    ``plan`` defaults to a fresh chunk plan of ``flat`` (one small job).
    ``keep_hit`` keeps the raw hit number as ``_hit``: with the time it is the
    order in which the rows are left.
    """
    plan = plan if plan is not None else session_plan(flat)
    ctx = ordered_context(
        flat, plan,
        row_number="_rn",
        lags=[("_url_prev", "url", 1, None),
              ("prev_page_template", "page_template", 1, MISSING),
              ("two_ahead_page_template", "page_template", 2, MISSING)],
        leads=[("next_page_template", "page_template", 1, MISSING)],
        firsts=[("entry_page_traffic_source", "traffic_source_grouped"),
                ("first_page_template", "page_template"),
                ("entry_page_traffic_source_raw", "traffic_source"),
                ("entry_page_traffic_medium", "traffic_medium")],
        lasts=[("last_page_template", "page_template")],
        counts=[("session_event_cnt", "page_template")],
        keep_chunk=keep_chunk,
    )
    prev_url = F.col("_url_prev")
    # LAG(url, 1, 'N/A'): the default only where no previous row exists.
    prev_or_missing = F.when(F.col("_rn") == 1, F.lit(MISSING)).otherwise(prev_url)
    cols = []
    for c in NAVIGATION_COLUMNS:
        if c == "event_seq_num":
            cols.append(F.col("_rn").alias(c))
        elif c == "url_lag":
            cols.append(F.coalesce(prev_url, F.lit(MISSING)).alias(c))
        elif c == "param_pairs":
            cols.append(F.regexp_extract_all("url", F.lit(PARAM_PAIR_PATTERN), 1).alias(c))
        else:
            cols.append(F.col(c))
    extra = ["_chunk", "_hot"] if keep_chunk else []
    if keep_hit:
        extra.append(F.col("event_seq_num").alias("_hit"))
    return ctx.filter(prev_or_missing != F.col("url")).select(*cols, *extra)
