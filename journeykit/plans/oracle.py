"""Oracle SQL (DuckDB dialect) for every catalog key.

The classification rules are generated from the values in ``functions.rules``
(tests/test_rules.py pins each value); the rest is written apart from the Spark
code: the flat events are derived straight from the ``events`` view with the fixture formulas of FIXTURES.md
§3, and each analysis is plain SQL over those rows. Ordered aggregates use
the same order as the Spark side: time, then hit number, NULLs first.
Integer sums and ``count_if`` are cast to BIGINT (DuckDB widens them).
"""

from __future__ import annotations

from journeykit.functions import rules as R

ORDER = "trace_time ASC NULLS FIRST, event_seq_num ASC NULLS FIRST"


# Page template of ``page_path`` and grouped source of ``source`` in DuckDB
# SQL, generated from the fixed rule values in ``functions.rules`` (the values
# themselves are pinned by the expectation tables of tests/test_rules.py).
# DuckDB evaluates the patterns with RE2, Spark with Java regexes; the
# differential test compares the two engines on random paths.


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _contains_any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_sql_text(w)})" for w in words) + ")"


def _in_list(expr: str, values: list[str]) -> str:
    return f"{expr} IN (" + ", ".join(_sql_text(v) for v in values) + ")"


def _case(rules: list[tuple[str, str]], default: str) -> str:
    arms = "\n".join(f"  WHEN {cond} THEN {label}" for label, cond in rules)
    return f"CASE\n{arms}\n  ELSE {default}\nEND"


def _page_template_sql(path: str = "page_path") -> str:
    low = f"lower({path})"
    plain = f"NOT regexp_matches({low}, {_sql_text(R.FUNCTIONAL_PATTERN)})"
    rules = [
        ("Asset", f"regexp_matches({path}, {_sql_text(R.ASSET_PATTERN)})"),
        ("Cart", _contains_any(low, R.CART_WORDS)),
        ("Checkout", _contains_any(low, R.CHECKOUT_WORDS)),
        ("OrderConfirmation", _contains_any(low, R.CONFIRMATION_WORDS)),
        ("SearchResults", f"({_contains_any(low, R.SEARCH_WORDS)} OR "
                          f"regexp_matches({low}, {_sql_text(R.SEARCH_PARAM_PATTERN)}))"),
        ("ProductQuickview", _contains_any(low, R.QUICKVIEW_WORDS)),
        ("StoreLocator", f"({_contains_any(low, R.STORE_LOCATOR_WORDS)} OR "
                         f"(contains({low}, {_sql_text(R.STORE_LOCATOR_PAIR[0])}) AND "
                         f"contains({low}, {_sql_text(R.STORE_LOCATOR_PAIR[1])})))"),
        ("Account", _contains_any(low, R.ACCOUNT_WORDS)),
        ("ProductDetail", f"regexp_matches({path}, {_sql_text(R.DEPTH3_PATTERN)}) AND {plain}"),
        ("CategoryPage", f"regexp_matches({path}, {_sql_text(R.DEPTH2_PATTERN)}) AND {plain}"),
        ("TopCategory", f"regexp_matches({path}, {_sql_text(R.DEPTH1_PATTERN)}) AND {plain} "
                        f"AND NOT {_in_list(low, R.NOT_TOP_CATEGORY)}"),
        ("Homepage", f"({_in_list(path, R.HOMEPAGE_PATHS)} OR {_in_list(low, R.HOMEPAGE_PATHS_ANY_CASE)})"),
    ]
    return _case([(_sql_text(label), cond) for label, cond in rules], "'Other'")


def _source_group_sql(source: str = "source") -> str:
    rules = [("'direct'", f"{source} IS NULL OR {_in_list(source, R.DIRECT_SOURCES)}")]
    rules += [(_sql_text(label), _contains_any(f"lower({source})", words)) for label, words in R.SOURCE_GROUPS]
    return _case(rules, source)


PAGE_TEMPLATE_SQL = _page_template_sql()
SOURCE_GROUP_SQL = _source_group_sql()

_BASE_TEMPLATE = r"""
ev AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events
),
ev_visit AS (
  SELECT *, CAST(floor((ms - 1704067200000) / 172800000) AS BIGINT) AS b FROM ev
),
ev_num AS (
  SELECT *,
    row_number() OVER (PARTITION BY user_id, b ORDER BY ms, event_id) AS hit_number,
    1704067200 + b * 172800 AS vst,
    (event_id * 31 + user_id * 17) % 18 AS path_idx,
    (user_id * 7 + b) % 10 AS src_idx
  FROM ev_visit
),
hit_rows AS (
  SELECT
    CASE WHEN user_id <> 7 THEN CAST(user_id AS VARCHAR) END AS full_visitor_id,
    b AS visit_id,
    vst,
    hit_number,
    ms - ms % 14400000 - vst * 1000 AS hit_time,
    CASE WHEN event_type = 'error' THEN 'EVENT'
         WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'TRANSACTION'
         ELSE 'PAGE' END AS hit_type,
    CASE WHEN event_type = 'purchase' THEN '/ordercompleted.html'
         WHEN event_id % 29 = 0 THEN NULL
         ELSE ['/home', '/', '/store.html', '/google+redesign/apparel',
               '/google+redesign/apparel/mens', '/google+redesign/apparel/mens/tee.axd',
               '/google+redesign/bags/backpacks/home?utm_source=feed&color=dark+blue',
               '/google+redesign/electronics/audio/cam?sku=7', '/basket.html',
               '/yourinfo.html?step=payment', '/asearch.html?keyword=a+b', '/signin.html',
               '/quickview/x', '/store-locator', '/home?ref=x&page=2', '/index.html', '/HOME',
               '/bags//sale'][path_idx + 1] END AS page_path,
    'h.example' AS hostname,
    ['desktop', 'mobile', 'tablet', NULL][(user_id + b) % 4 + 1] AS device_category,
    ['(direct)', 'google', 'google', 'youtube.com', 'm.facebook.com', 'bing', 't.co',
     '(not set)', NULL, 'Partners'][src_idx + 1] AS source,
    ['(none)', 'organic', 'cpc', 'referral', 'referral', 'organic', 'referral',
     '(not set)', NULL, 'affiliate'][src_idx + 1] AS medium,
    user_id,
    CASE WHEN event_type <> 'purchase' AND path_idx IN (6, 7)
         THEN ['Home/Apparel/Kid''s/Kids-Youth/', 'Home/Electronics/Audio/', '(not set)',
               'Home/Bags/'][event_id % 4 + 1] END AS first_category,
    CASE WHEN event_type = 'purchase' AND event_id % 2 = 1 THEN '6' ELSE '0' END AS action_type
  FROM ev_num
),
flat AS (
  SELECT
    full_visitor_id || '-' || CAST(visit_id AS VARCHAR) AS session_id,
    vst * 1000 + hit_time AS trace_time,
    hit_number AS event_seq_num,
    page_path AS url_path,
    hostname AS url_host,
    'https://' || hostname || page_path AS url,
    device_category AS device_type,
    hit_type AS page_type,
    {PAGE_TEMPLATE_SQL} AS page_template,
    source AS traffic_source,
    medium AS traffic_medium,
    CASE WHEN medium = 'cpc' THEN 'brand' END AS traffic_campaign,
    CAST(NULL AS VARCHAR) AS traffic_ad_content,
    CASE WHEN source = 'google' THEN '(not provided)' END AS traffic_keyword,
    CASE WHEN medium = 'cpc' THEN 'g' || CAST(user_id AS VARCHAR) END AS gclid,
    {SOURCE_GROUP_SQL} AS traffic_source_grouped,
    nullif(regexp_extract(first_category, '^Home/([^/]+)', 1), '') AS product_category,
    first_category AS product_category_full,
    action_type AS ecommerce_action_type,
    CASE WHEN action_type = '6' THEN TRUE WHEN hit_type = 'TRANSACTION' THEN TRUE ELSE FALSE END AS is_conversion
  FROM hit_rows
  WHERE hit_type IN ('PAGE', 'TRANSACTION')
)"""
_BASE = (_BASE_TEMPLATE.replace("{PAGE_TEMPLATE_SQL}", PAGE_TEMPLATE_SQL.replace("\n", "\n    "))
         .replace("{SOURCE_GROUP_SQL}", SOURCE_GROUP_SQL.replace("\n", "\n    ")))

_FACTS = f"""
device_rank AS (
  SELECT session_id, device_type,
    row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, device_type ASC NULLS FIRST) AS rk
  FROM flat GROUP BY session_id, device_type
),
facts AS (
  SELECT f.session_id,
    string_agg(page_template, ' -> ' ORDER BY {ORDER}) AS journey_path,
    count(*) AS journey_steps,
    (max(trace_time) - min(trace_time)) / 1000 AS journey_duration_seconds,
    max(d.device_type) AS primary_device_type,
    first(page_template ORDER BY {ORDER}) AS entry_page_template,
    first(traffic_source_grouped ORDER BY {ORDER}) AS traffic_source_first,
    first(traffic_medium ORDER BY {ORDER}) AS traffic_medium_first,
    first(traffic_campaign ORDER BY {ORDER}) AS traffic_campaign_first,
    bool_or(page_template = 'ProductDetail') AS saw_product_detail,
    bool_or(is_conversion = TRUE) AS has_conversion,
    max(trace_time) - min(trace_time) AS journey_duration_ms
  FROM flat f
  LEFT JOIN device_rank d ON d.session_id IS NOT DISTINCT FROM f.session_id AND d.rk = 1
  GROUP BY f.session_id
)"""

_NAV = f"""
nav_all AS (
  SELECT session_id, trace_time, page_template, url, traffic_source, traffic_source_grouped,
    traffic_medium, traffic_campaign,
    first_value(traffic_source_grouped) OVER w AS entry_page_traffic_source,
    device_type, page_type, product_category, product_category_full, is_conversion,
    row_number() OVER w AS event_seq_num,
    coalesce(lag(url) OVER w, 'N/A') AS url_lag,
    lag(page_template, 1, 'N/A') OVER w AS prev_page_template,
    lead(page_template, 1, 'N/A') OVER w AS next_page_template,
    lag(page_template, 2, 'N/A') OVER w AS two_ahead_page_template,
    first_value(page_template) OVER w AS first_page_template,
    last_value(page_template) OVER (PARTITION BY session_id ORDER BY {ORDER}
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_page_template,
    count(page_template) OVER (PARTITION BY session_id) AS session_event_cnt,
    url_host, url_path,
    regexp_extract_all(url, '[?&]((?:[^=]+)=(?:[^&]+))', 1) AS param_pairs,
    first_value(traffic_source) OVER w AS entry_page_traffic_source_raw,
    first_value(traffic_medium) OVER w AS entry_page_traffic_medium,
    lag(url, 1, 'N/A') OVER w <> url AS keep_row
  FROM flat
  WINDOW w AS (PARTITION BY session_id ORDER BY {ORDER})
),
nav AS (SELECT * EXCLUDE (keep_row) FROM nav_all WHERE keep_row)"""

_PARAMS = """
nav_pairs AS (
  SELECT *, unnest(CASE WHEN param_pairs IS NULL OR len(param_pairs) = 0
                        THEN [CAST(NULL AS VARCHAR)] ELSE param_pairs END) AS pair
  FROM nav
),
params AS (
  SELECT session_id, trace_time, page_template, url, traffic_source, traffic_source_grouped,
    traffic_medium, page_type, product_category, product_category_full, is_conversion,
    event_seq_num, url_lag, url_host, url_path, prev_page_template, next_page_template,
    two_ahead_page_template, entry_page_traffic_source, last_page_template, session_event_cnt,
    entry_page_traffic_source_raw, entry_page_traffic_medium,
    regexp_extract(pair, '([^=]+)', 1) AS param_name,
    replace(regexp_extract(pair, '[^=]+=([^&]+)', 1), '+', ' ') AS param_value
  FROM nav_pairs
)"""

_SEQ = """
seq_steps AS (SELECT * FROM nav),
seq_device AS (
  SELECT session_id, device_type,
    row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, device_type ASC NULLS FIRST) AS rk
  FROM seq_steps GROUP BY session_id, device_type
),
seq_source AS (
  SELECT session_id, traffic_source_grouped,
    row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, traffic_source_grouped ASC NULLS FIRST) AS rk
  FROM seq_steps GROUP BY session_id, traffic_source_grouped
),
seq_base AS (
  SELECT session_id,
    count(*) AS event_cnt,
    string_agg(page_template, ' > ' ORDER BY event_seq_num) AS journey_fingerprint_str,
    array_to_string(list_slice(list(page_template ORDER BY event_seq_num), 1, 5), ' > ')
      AS journey_fingerprint_first_five_str,
    first(page_template ORDER BY trace_time ASC NULLS FIRST, event_seq_num) AS entry_page_template,
    first(entry_page_traffic_source_raw ORDER BY trace_time ASC NULLS FIRST, event_seq_num)
      AS entry_page_traffic_source_session_lvl,
    first(traffic_source ORDER BY trace_time ASC NULLS FIRST, event_seq_num) AS entry_page_source,
    first(traffic_medium ORDER BY trace_time ASC NULLS FIRST, event_seq_num) AS entry_page_medium,
    bool_or(lower(page_template) = 'productdetail') AS saw_product_detail,
    bool_or(is_conversion = TRUE) AS had_conversion,
    CAST(sum(CASE WHEN is_conversion = TRUE THEN 1 ELSE 0 END) AS BIGINT) AS conversion_cnt
  FROM seq_steps GROUP BY session_id
),
seq_facts AS (
  SELECT b.session_id, b.event_cnt, b.journey_fingerprint_str,
    b.journey_fingerprint_first_five_str, b.entry_page_template,
    b.entry_page_traffic_source_session_lvl, b.entry_page_source, b.entry_page_medium,
    d.device_type AS primary_device_type, s.traffic_source_grouped AS primary_traffic_source,
    b.saw_product_detail, b.had_conversion, b.conversion_cnt
  FROM seq_base b
  LEFT JOIN seq_device d ON d.session_id IS NOT DISTINCT FROM b.session_id AND d.rk = 1
  LEFT JOIN seq_source s ON s.session_id IS NOT DISTINCT FROM b.session_id AND s.rk = 1
)"""

_ENRICHED = """
enriched AS (
  SELECT p.*, s.event_cnt, s.journey_fingerprint_str, s.journey_fingerprint_first_five_str,
    s.entry_page_template, s.entry_page_source, s.entry_page_medium, s.primary_device_type,
    s.primary_traffic_source, s.saw_product_detail, s.had_conversion, s.conversion_cnt
  FROM params p LEFT JOIN seq_facts s ON p.session_id = s.session_id
)"""

def _any_row(cond: str) -> str:
    """1 when some row of the session satisfies ``cond`` (NULL counts as no)."""
    return f"CAST(max(CASE WHEN coalesce({cond}, false) THEN 1 ELSE 0 END) AS BIGINT)"


_FLAGS = f"""
flags AS (
  SELECT session_id,
    {_any_row("contains(lower(traffic_source), 'google')")} AS google_source_flag,
    {_any_row("traffic_source_grouped = 'google'")} AS google_grouped_flag,
    {_any_row("traffic_source_grouped = 'google' AND traffic_medium = 'organic'")} AS google_organic_flag,
    {_any_row("traffic_source_grouped = 'google' AND traffic_medium = 'cpc'")} AS google_cpc_flag,
    {_any_row("event_seq_num = 1 AND traffic_source_grouped = 'google'")} AS google_first_event_flag
  FROM enriched GROUP BY session_id
)"""

_LAYERS = {
    "flat": [_BASE],
    "facts": [_BASE, _FACTS],
    "nav": [_BASE, _NAV],
    "params": [_BASE, _NAV, _PARAMS],
    "seq": [_BASE, _NAV, _SEQ],
    "enriched": [_BASE, _NAV, _PARAMS, _SEQ, _ENRICHED],
    "flags": [_BASE, _NAV, _PARAMS, _SEQ, _ENRICHED, _FLAGS],
}


def _with(layer: str, select: str) -> str:
    """The layers and a query over them; ``select`` may add relations of its own after a comma."""
    return "WITH " + ",".join(_LAYERS[layer]) + "\n" + select.strip()


def _cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def _pct(cond: str) -> str:
    return f"round(CAST({_cnt(cond)} AS DOUBLE) * 100.0 / count(*), 2)"


_AVG_DURATION = ("CASE WHEN count(journey_duration_ms) > 0 THEN "
                 "sum(journey_duration_ms) / count(journey_duration_ms) / 1000.0 END")


def _device_count(device: str) -> str:
    return f"count(*) FILTER (WHERE lower(primary_device_type) = '{device}') AS {device}_sessions"


_DEVICES = ", ".join(_device_count(d) for d in ("desktop", "mobile", "tablet"))

_FACT_COLS = ("session_id, journey_path, journey_steps, journey_duration_seconds, primary_device_type, "
              "entry_page_template, traffic_source_first, traffic_medium_first, traffic_campaign_first, "
              "saw_product_detail, has_conversion")


def _entry_outcomes(entry: str, prefix: str) -> str:
    return _with("facts", f"""
SELECT CASE WHEN saw_product_detail = TRUE THEN '{prefix}_sessions_with_product_detail'
            WHEN saw_product_detail = FALSE AND journey_steps = 1 THEN '{prefix}_sessions_bounce'
            ELSE '{prefix}_sessions_without_product_detail' END AS session_type,
  count(*) AS total_sessions, {_DEVICES},
  {_cnt('has_conversion = TRUE')} AS has_conversion,
  {_cnt('has_conversion = FALSE')} AS no_conversion
FROM facts WHERE entry_page_template IN ({entry})
GROUP BY 1""")


ORACLE_SQL: dict[str, str] = {
    "preprocess_hits": _with("flat", "SELECT * FROM flat"),
    "first_touch": _with("flat", f"""
SELECT *,
  first_value(traffic_source_grouped) OVER w AS traffic_source_first,
  first_value(traffic_medium) OVER w AS traffic_medium_first,
  first_value(traffic_campaign) OVER w AS traffic_campaign_first
FROM flat
WINDOW w AS (PARTITION BY session_id ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "session_facts": _with("facts", f"SELECT {_FACT_COLS} FROM facts"),
    "navigation_context": _with("nav", "SELECT * FROM nav"),
    "url_params": _with("params", "SELECT * FROM params"),
    "sequence_session_facts": _with("seq", "SELECT * FROM seq_facts"),
    "enriched_events": _with("enriched", "SELECT * FROM enriched"),
    "events_by_page_template": _with("flat", """
SELECT page_template, count(*) AS cnt FROM flat GROUP BY page_template
ORDER BY cnt DESC, page_template LIMIT 50"""),
    "source_medium_single_product": _with("facts", """
SELECT coalesce(traffic_source_first, '(direct)') || ' / ' || coalesce(traffic_medium_first, '(none)') AS source_medium,
  count(*) AS session_count
FROM facts WHERE journey_path = 'ProductDetail' GROUP BY 1"""),
    "traffic_medium_frequency": _with("facts", """
SELECT traffic_medium_first, count(*) AS cnt FROM facts GROUP BY 1"""),
    "traffic_source_frequency": _with("facts", """
SELECT traffic_source_first, count(*) AS cnt FROM facts GROUP BY 1"""),
    "journey_frequency_by_device": _with("facts", f"""
SELECT journey_path, count(DISTINCT session_id) AS session_count,
  {_AVG_DURATION} AS avg_duration_sec,
  min(journey_steps) AS steps, {_DEVICES}
FROM facts GROUP BY journey_path"""),
    "sessions_by_source_type": _with("flat", """
SELECT source_type, count(DISTINCT session_id) AS cnt
FROM (SELECT session_id, CASE lower(traffic_source_grouped) WHEN 'google' THEN 'google-touched'
        ELSE if(traffic_source_grouped = 'direct', 'direct', 'other source') END AS source_type FROM flat)
GROUP BY ALL"""),
    "bounce_non_google": _with("facts", f"""
SELECT count(*) AS source_count, {_cnt('journey_steps = 1')} AS bounce,
  {_cnt('journey_steps > 1')} AS not_bounce
FROM facts WHERE traffic_source_first <> 'google'"""),
    "conversion_totals": _with("facts", f"""
SELECT count(*) AS source_count, {_cnt('has_conversion = FALSE')} AS no_conversion,
  {_cnt('has_conversion = TRUE')} AS has_conversion
FROM facts"""),
    "landing_page_frequency": _with("flat", """
SELECT page_template, count(*) AS cnt FROM flat WHERE event_seq_num = 1 GROUP BY page_template"""),
    "homepage_entry_outcomes": _entry_outcomes("'Homepage'", "homepage"),
    "category_entry_outcomes": _entry_outcomes("'CategoryPage', 'TopCategory'", "category"),
    "product_impressions_by_category": _with("flat", """
SELECT product_category, count(*) AS category_impressions
FROM flat WHERE page_template = 'ProductDetail' GROUP BY product_category"""),
    "medium_performance": _with("facts", f"""
SELECT traffic_medium_first, count(*) AS session_count,
  {_cnt('journey_steps = 1')} AS bounce_count,
  {_cnt('has_conversion = TRUE')} AS conversion_count,
  {_pct('journey_steps = 1')} AS bounce_rate_pct,
  {_pct('has_conversion = TRUE')} AS conversion_rate_pct
FROM facts GROUP BY traffic_medium_first"""),
    "channel_group_performance": _with("facts", f"""
SELECT CASE WHEN traffic_medium_first = 'cpc' THEN 'Paid Search'
            WHEN traffic_medium_first = 'organic' THEN 'Organic Search'
            WHEN traffic_medium_first IN ('referral') THEN 'Referral'
            WHEN traffic_medium_first = '(none)' OR traffic_medium_first IS NULL THEN 'Direct'
            ELSE 'Other' END AS channel_group,
  count(*) AS session_count,
  avg(journey_steps) AS avg_journey_steps,
  {_AVG_DURATION} AS avg_duration_sec,
  {_pct('has_conversion = TRUE')} AS conversion_rate_pct
FROM facts GROUP BY 1"""),
    "bigram_transitions": _with("nav", """
SELECT concat_ws(' > ', prev_page_template, page_template) AS page_template_transition,
  count(*) AS transitions_count
FROM nav WHERE session_event_cnt > 1 GROUP BY ALL"""),
    "trigram_transitions": _with("nav", """
SELECT concat_ws(' > ', two_ahead_page_template, prev_page_template,
    if(traffic_source_grouped <> 'direct', '(external) ', '') || page_template) AS page_template_transition,
  count(*) AS transitions_count
FROM nav WHERE session_event_cnt > 2 GROUP BY ALL"""),
    "enriched_event_count": _with("enriched", "SELECT count(*) AS cnt FROM enriched"),
    "session_google_flags": _with("flags", "SELECT * FROM flags"),
    "google_traffic_totals": _with("flags", """
SELECT CAST(sum(google_source_flag) AS BIGINT) AS google_source_sessions_cnt,
  CAST(sum(google_grouped_flag) AS BIGINT) AS google_grouped_sessions_cnt,
  CAST(sum(google_organic_flag) AS BIGINT) AS google_organic_cnt,
  CAST(sum(google_cpc_flag) AS BIGINT) AS google_cpc_cnt,
  CAST(sum(google_first_event_flag) AS BIGINT) AS google_first_event_cnt
FROM flags"""),
    "journey_fingerprint_frequency": _with("seq", """
SELECT journey_fingerprint_str, count(*) AS cnt FROM seq_facts GROUP BY 1"""),
    "entry_source_medium": _with("seq", """
SELECT entry_page_source, entry_page_medium, count(*) AS cnt FROM seq_facts GROUP BY 1, 2"""),
    "category_frequency": _with("enriched", """,
products AS (SELECT product_category FROM enriched WHERE page_template = 'ProductDetail')
SELECT product_category, count(*) AS cnt, count(*) / (SELECT count(*) FROM products) AS cnt_pct
FROM products GROUP BY product_category
ORDER BY cnt DESC, product_category ASC NULLS FIRST LIMIT 100"""),
    "single_product_journeys_by_source": _with("seq", """
SELECT journey_fingerprint_str,
  coalesce(entry_page_traffic_source_session_lvl, primary_traffic_source) AS entry_page_traffic_source,
  count(*) AS cnt
FROM seq_facts GROUP BY 1, 2 HAVING journey_fingerprint_str = 'ProductDetail'"""),
    "traffic_by_source": _with("enriched", """
SELECT coalesce(traffic_source, primary_traffic_source) AS primary_source, traffic_medium,
  count(DISTINCT session_id) AS cnt
FROM enriched GROUP BY 1, 2"""),
    "entry_traffic_by_source": _with("enriched", """
SELECT coalesce(entry_page_traffic_source, primary_traffic_source) AS primary_source,
  entry_page_medium, count(DISTINCT session_id) AS cnt
FROM enriched WHERE event_seq_num = 1 GROUP BY 1, 2"""),
    "sessions_by_journey": _with("enriched", """
SELECT journey_fingerprint_str, count(DISTINCT session_id) AS cnt FROM enriched GROUP BY 1"""),
    "sample_session": _with("params", """
SELECT epoch_ms(trace_time) AS trace_timestamp_millis, *
FROM params WHERE session_id = (SELECT min(session_id) FROM params)"""),
    # hit rows of the visits that start on the days of the range
    "preprocess_hits_date_range": _with("flat", "SELECT * FROM flat").replace(
        "  FROM ev_num\n", "  FROM ev_num WHERE strftime(make_timestamp(vst * 1000000), '%Y%m%d') "
        "BETWEEN '20240103' AND '20240112'\n"),
}

# Keys that read the same rows from saved shards or tables.
ORACLE_SQL["preprocess_hits_from_shards"] = ORACLE_SQL["preprocess_hits_date_range"]
ORACLE_SQL["session_facts_from_shards"] = ORACLE_SQL["session_facts"]
ORACLE_SQL["session_facts_incremental"] = ORACLE_SQL["session_facts"]
ORACLE_SQL.update({f"{key}_from_table": ORACLE_SQL[key] for key in (
    "session_facts", "navigation_context", "enriched_events")})
