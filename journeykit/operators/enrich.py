"""C7 enriched events (event × parameter rows with session facts) and C8
per-session Google attribution flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeykit.operators.sequence_facts import sequence_session_facts, with_session_facts
from journeykit.operators.url_params import URL_PARAM_COLUMNS, url_params

ENRICH_FACT_COLUMNS = [
    "event_cnt", "journey_fingerprint_str", "journey_fingerprint_first_five_str",
    "entry_page_template", "entry_page_source", "entry_page_medium",
    "primary_device_type", "primary_traffic_source", "saw_product_detail",
    "had_conversion", "conversion_cnt",
]

# Fixed values of the attribution flags.
GOOGLE = "google"
ORGANIC = "organic"
CPC = "cpc"


def events_with_facts(navigation: DataFrame) -> DataFrame:
    """Events with the sequencing facts of their session (rows with a NULL id
    have NULL facts).

    The facts are windows over the navigation step's own partitioning and sort:
    one scan, one exchange, no join. The rows of hot sessions, which
    ``navigation`` marks, are joined with their facts instead: these are built
    per chunk, and adaptive execution splits a hot session's rows."""
    facts = ENRICH_FACT_COLUMNS
    if "_hot" not in navigation.columns:
        return with_session_facts(navigation, facts)
    cold = with_session_facts(navigation.where(~F.col("_hot")), facts)
    hot = navigation.where("_hot")
    joined = hot.join(sequence_session_facts(hot).select("session_id", *facts), "session_id", "left")
    return cold.unionByName(joined.select(*cold.columns))


def enriched_events(navigation: DataFrame) -> DataFrame:
    """C7: one row per event and URL parameter with the session's facts."""
    return url_params(events_with_facts(navigation)).select(*URL_PARAM_COLUMNS, *ENRICH_FACT_COLUMNS)


def _flag(cond: F.Column) -> F.Column:
    # "any row of the session" — max of a 0/1 value merges map-side.
    return F.max(F.when(cond, 1).otherwise(0)).cast("bigint")


def session_source_flags(navigation: DataFrame) -> DataFrame:
    """C8: five 0/1 flags per session — Google in the raw source, in the
    grouped source, Google organic, Google cpc, and Google on event 1.

    The flags only ask whether *some* row qualifies, and every event has at
    least one enriched row, so they are computed on the events directly:
    the parameter fan-out and the facts join change nothing here."""
    grouped_google = F.col("traffic_source_grouped") == GOOGLE
    return navigation.groupBy("session_id").agg(
        _flag(F.lower("traffic_source").contains(GOOGLE)).alias("google_source_flag"),
        _flag(grouped_google).alias("google_grouped_flag"),
        _flag(grouped_google & (F.col("traffic_medium") == ORGANIC)).alias("google_organic_flag"),
        _flag(grouped_google & (F.col("traffic_medium") == CPC)).alias("google_cpc_flag"),
        _flag((F.col("event_seq_num") == 1) & grouped_google).alias("google_first_event_flag"),
    )
