"""Page-to-page transitions (bi-grams and tri-grams) on refresh-free events.

The start of a session keeps its ``N/A`` neighbours, and neighbours are
taken before refresh removal (so ``A, A(refresh), B`` yields ``A > A > B``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeykit.functions.rules import DIRECT_SOURCES

SEP = " > "
EXTERNAL_PREFIX = "(external) "


def _external_entry() -> F.Column:
    """The event came from a raw source that is neither direct nor unset."""
    src = F.col("traffic_source")
    return (src.isNotNull() & ~src.isin(*DIRECT_SOURCES)) & (F.col("traffic_source_grouped") != "direct")


def page_transitions(navigation: DataFrame, n: int = 2) -> DataFrame:
    """Count transitions of length ``n`` (2 or 3) in sessions with ≥ n events.

    Tri-grams mark the current page ``(external)`` when the event came from a
    non-direct traffic source."""
    steps = navigation.filter(
        (F.col("session_event_cnt") >= n) & ~(F.col("url_lag") == F.col("url"))
    )
    if n == 2:
        key = F.concat(F.col("prev_page_template"), F.lit(SEP), F.col("page_template"))
    elif n == 3:
        current = F.when(_external_entry(), F.concat(F.lit(EXTERNAL_PREFIX), F.col("page_template"))) \
            .otherwise(F.col("page_template"))
        key = F.concat(F.col("two_ahead_page_template"), F.lit(SEP),
                       F.col("prev_page_template"), F.lit(SEP), current)
    else:
        raise ValueError("n must be 2 or 3")
    counts = steps.groupBy(key.alias("page_template_transition")).agg(
        F.count(F.lit(1)).alias("transitions_count"))
    return counts.orderBy(F.desc("transitions_count"), F.asc("page_template_transition"))
