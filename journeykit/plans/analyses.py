"""Named journey / attribution analyses (Q1–Q27), DataFrame → DataFrame.

Result columns carry the names of the original outputs. Ordering inside a
named relation has no effect on results and is left out; a final order is
only kept where it is part of the feature (a top-k report).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeykit.functions.rules import channel_group, source_type

TOP_TEMPLATES = 50
TOP_CATEGORIES = 100


def _ranked(df: DataFrame, by: str, *keys: str, descending: bool = True) -> DataFrame:
    """Final presentation order of an output: ``by`` (descending by default),
    group keys as tie-break. A range-partitioned sort, so it scales with the
    number of result rows."""
    first = F.desc(by) if descending else F.asc(by)
    return df.orderBy(first, *[F.asc_nulls_first(k) for k in keys])


def _count(name: str = "cnt") -> F.Column:
    return F.count(F.lit(1)).alias(name)


def _count_if(cond: F.Column, name: str) -> F.Column:
    return F.count_if(cond).alias(name)


def _device_counts() -> list[F.Column]:
    dev = F.lower("primary_device_type")
    return [
        _count_if(dev == "desktop", "desktop_sessions"),
        _count_if(dev == "mobile", "mobile_sessions"),
        _count_if(dev == "tablet", "tablet_sessions"),
    ]


def _pct(cond: F.Column) -> F.Column:
    # DOUBLE arithmetic (a Python float literal is a double in Spark).
    return F.round(F.count_if(cond) * 100.0 / F.count(F.lit(1)), 2)


def _avg_duration_sec() -> F.Column:
    # Mean of (max - min) / 1000 over sessions, summed as exact integers so
    # the value does not depend on the order partial sums are merged in.
    d = F.col("journey_duration_ms")
    return F.when(F.count(d) > 0, F.sum(d) / F.count(d) / 1000.0)


# --- on flat events (C1) -----------------------------------------------------

def events_by_page_template(flat: DataFrame) -> DataFrame:
    """Q1: events per page template, top 50."""
    return (flat.groupBy("page_template").agg(_count())
            .orderBy(F.desc("cnt"), F.asc("page_template")).limit(TOP_TEMPLATES))


def sessions_by_source_type(flat: DataFrame) -> DataFrame:
    """Q6: distinct sessions touched by google / direct / other sources."""
    out = flat.groupBy(source_type("traffic_source_grouped").alias("source_type")).agg(
        F.count_distinct("session_id").alias("cnt"))
    return _ranked(out, "cnt", "source_type")


def landing_page_frequency(flat: DataFrame) -> DataFrame:
    """Q9: templates of raw hit number 1."""
    out = flat.filter(F.col("event_seq_num") == 1).groupBy("page_template").agg(_count())
    return _ranked(out, "cnt", "page_template")


def product_impressions_by_category(flat: DataFrame) -> DataFrame:
    """Q12: product-detail events per top-level category (event grain)."""
    out = (flat.filter(F.col("page_template") == "ProductDetail")
           .groupBy("product_category").agg(_count("category_impressions")))
    return _ranked(out, "category_impressions", "product_category")


# --- on session facts (C3, with journey_duration_ms) --------------------------

def source_medium_single_product(facts: DataFrame) -> DataFrame:
    """Q2: "source / medium" of sessions whose whole path is one product page."""
    sm = F.concat(F.coalesce("traffic_source_first", F.lit("(direct)")), F.lit(" / "),
                  F.coalesce("traffic_medium_first", F.lit("(none)")))
    # one step, and the entry page is that step: no path string is built
    out = (facts.filter((F.col("journey_steps") == 1) & (F.col("entry_page_template") == "ProductDetail"))
           .groupBy(sm.alias("source_medium")).agg(_count("session_count")))
    return _ranked(out, "session_count", "source_medium")


def traffic_medium_frequency(facts: DataFrame) -> DataFrame:
    """Q3."""
    return _ranked(facts.groupBy("traffic_medium_first").agg(_count()), "cnt", "traffic_medium_first")


def traffic_source_frequency(facts: DataFrame) -> DataFrame:
    """Q4."""
    return _ranked(facts.groupBy("traffic_source_first").agg(_count()), "cnt", "traffic_source_first")


def journey_frequency_by_device(facts: DataFrame) -> DataFrame:
    """Q5: per journey path — sessions, mean duration, steps, device split."""
    out = facts.groupBy("journey_path").agg(
        # the facts hold one row per session
        F.count("session_id").alias("session_count"),
        _avg_duration_sec().alias("avg_duration_sec"),
        # the step count is a function of the path: any value of the group
        F.min("journey_steps").alias("steps"),
        *_device_counts(),
    )
    return _ranked(out, "session_count", "journey_path")


def bounce_non_google(facts: DataFrame) -> DataFrame:
    """Q7: one row over sessions whose first source is not google."""
    return facts.filter(F.col("traffic_source_first") != "google").agg(
        _count("source_count"),
        _count_if(F.col("journey_steps") == 1, "bounce"),
        _count_if(F.col("journey_steps") > 1, "not_bounce"),
    )


def conversion_totals(facts: DataFrame) -> DataFrame:
    """Q8: one row over all sessions."""
    return facts.agg(
        _count("source_count"),
        _count_if(~F.col("has_conversion"), "no_conversion"),
        _count_if(F.col("has_conversion"), "has_conversion"),
    )


def _entry_outcomes(facts: DataFrame, entry: list[str], prefix: str) -> DataFrame:
    kind = (F.when(F.col("saw_product_detail"), F.lit(f"{prefix}_sessions_with_product_detail"))
            .when(~F.col("saw_product_detail") & (F.col("journey_steps") == 1), F.lit(f"{prefix}_sessions_bounce"))
            .otherwise(F.lit(f"{prefix}_sessions_without_product_detail")))
    out = (facts.filter(F.col("entry_page_template").isin(*entry))
           .groupBy(kind.alias("session_type"))
           .agg(_count("total_sessions"), *_device_counts(),
                _count_if(F.col("has_conversion"), "has_conversion"),
                _count_if(~F.col("has_conversion"), "no_conversion")))
    return _ranked(out, "session_type")


def homepage_entry_outcomes(facts: DataFrame) -> DataFrame:
    """Q10."""
    return _entry_outcomes(facts, ["Homepage"], "homepage")


def category_entry_outcomes(facts: DataFrame) -> DataFrame:
    """Q11."""
    return _entry_outcomes(facts, ["CategoryPage", "TopCategory"], "category")


def medium_performance(facts: DataFrame) -> DataFrame:
    """Q13: per first medium — sessions, bounces, conversions and both rates."""
    bounce = F.col("journey_steps") == 1
    conv = F.col("has_conversion")
    out = facts.groupBy("traffic_medium_first").agg(
        _count("session_count"),
        _count_if(bounce, "bounce_count"),
        _count_if(conv, "conversion_count"),
        _pct(bounce).alias("bounce_rate_pct"),
        _pct(conv).alias("conversion_rate_pct"),
    )
    return _ranked(out, "session_count", "traffic_medium_first")


def channel_group_performance(facts: DataFrame) -> DataFrame:
    """Q14: paid / organic / referral / direct / other performance."""
    out = facts.groupBy(channel_group("traffic_medium_first").alias("channel_group")).agg(
        _count("session_count"),
        F.avg("journey_steps").alias("avg_journey_steps"),
        _avg_duration_sec().alias("avg_duration_sec"),
        _pct(F.col("has_conversion")).alias("conversion_rate_pct"),
    )
    return _ranked(out, "session_count", "channel_group")


# --- on the sequencing chain (C4–C8) -------------------------------------------

def enriched_event_count(params: DataFrame) -> DataFrame:
    """Q17: rows of the enriched relation. The facts join is one-to-one per
    session, so the count is that of the event × parameter rows."""
    return params.agg(_count("cnt"))


def google_traffic_totals(flags: DataFrame) -> DataFrame:
    """Q19: totals of the five per-session flags (one row)."""
    names = ["google_source_flag", "google_grouped_flag", "google_organic_flag",
             "google_cpc_flag", "google_first_event_flag"]
    out = ["google_source_sessions_cnt", "google_grouped_sessions_cnt",
           "google_organic_cnt", "google_cpc_cnt", "google_first_event_cnt"]
    return flags.agg(*[F.sum(n).cast("bigint").alias(o) for n, o in zip(names, out)])


def journey_fingerprint_frequency(seq_facts: DataFrame) -> DataFrame:
    """Q20."""
    return _ranked(seq_facts.groupBy("journey_fingerprint_str").agg(_count()), "cnt", "journey_fingerprint_str")


def entry_source_medium(seq_facts: DataFrame) -> DataFrame:
    """Q21."""
    out = seq_facts.groupBy("entry_page_source", "entry_page_medium").agg(_count())
    return _ranked(out, "cnt", "entry_page_source", "entry_page_medium")


def category_frequency(params: DataFrame) -> DataFrame:
    """Q22: product-detail rows per category at event × parameter grain, with
    the share of all such rows (taken before the top-100 cut)."""
    rows = params.filter((F.col("page_template") == "ProductDetail") & ~(F.col("url_lag") == F.col("url")))
    # Categories and their total in one pass; the total sorts first, so it is
    # among the rows that the cut leaves, and the window sees these few only.
    counts = (rows.groupingSets([["product_category"], []], "product_category")
              .agg(_count(), F.grouping("product_category").alias("_all")))
    order = [F.desc("cnt"), F.asc_nulls_first("product_category")]
    top = counts.orderBy(F.desc("_all"), *order).limit(TOP_CATEGORIES + 1)
    total = F.max(F.when(F.col("_all") == 1, F.col("cnt"))).over(Window.partitionBy())
    return (top.withColumn("_total", total).where("_all = 0")
            .select("product_category", "cnt", (F.col("cnt") / F.col("_total")).alias("cnt_pct")).orderBy(*order))


def single_product_journeys_by_source(seq_facts: DataFrame) -> DataFrame:
    """Q23: single-product-page journeys by entry source (primary source as
    fallback)."""
    src = F.coalesce("entry_page_traffic_source_session_lvl", "primary_traffic_source")
    # one step, and the entry page is that step: no fingerprint is built
    out = (seq_facts.filter((F.col("event_cnt") == 1) & (F.col("entry_page_template") == "ProductDetail"))
           .groupBy(F.lit("ProductDetail").alias("journey_fingerprint_str"), src.alias("entry_page_traffic_source"))
           .agg(_count()))
    return _ranked(out, "cnt", "entry_page_traffic_source")


def traffic_by_source(events: DataFrame) -> DataFrame:
    """Q24: distinct sessions per (raw source or majority source, medium).

    Every event has an enriched row, so the events with their session's facts
    hold the same sessions: no parameter is taken apart. They are partitioned by
    session, which the distinct count starts from without another exchange."""
    src = F.coalesce("traffic_source", "primary_traffic_source")
    out = events.groupBy(src.alias("primary_source"), "traffic_medium").agg(
        F.count_distinct("session_id").alias("cnt"))
    return _ranked(out, "cnt", "primary_source", "traffic_medium")


def entry_traffic_by_source(events: DataFrame) -> DataFrame:
    """Q25: first events only — grouped entry source (majority source as
    fallback) and the session's entry medium, distinct sessions."""
    src = F.coalesce("entry_page_traffic_source", "primary_traffic_source")
    out = (events.filter(F.col("event_seq_num") == 1)
           .groupBy(src.alias("primary_source"), "entry_page_medium")
           .agg(F.count_distinct("session_id").alias("cnt")))
    return _ranked(out, "cnt", "primary_source", "entry_page_medium")


def sessions_by_journey(seq_facts: DataFrame) -> DataFrame:
    """Q26: distinct sessions of the enriched rows per fingerprint, counted
    from the facts, which hold one row per session. Rows with a NULL session
    id have no fingerprint there: a NULL group that counts no session."""
    fingerprint = F.when(F.col("session_id").isNotNull(), F.col("journey_fingerprint_str"))
    out = (seq_facts.groupBy(fingerprint.alias("journey_fingerprint_str"))
           .agg(F.count("session_id").alias("cnt")))
    return _ranked(out, "cnt", "journey_fingerprint_str")


def smallest_session_with_urls(flat: DataFrame) -> DataFrame:
    """The smallest id of a session none of whose URLs is NULL (one row), read
    from the ids and whether the URLs are there."""
    whole = flat.groupBy("session_id").agg(F.bool_and(F.col("url").isNotNull()).alias("_whole"))
    return whole.where("_whole").agg(F.min("session_id"))


def session_rows(params: DataFrame) -> DataFrame:
    """Event × parameter rows with the event time as a timestamp first."""
    ts = F.expr("timestampadd(MILLISECOND, trace_time, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    rows = params.select(ts.alias("trace_timestamp_millis"), "*")
    return rows.orderBy(F.asc("event_seq_num"), F.asc_nulls_first("param_name"))
