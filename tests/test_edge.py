"""Edge cases on a hand-written flat table (FIXTURES.md §5)."""

from pyspark.sql import functions as F

from fixtures import flat_from_rows
from journeykit.operators.enrich import enriched_events
from journeykit.operators.navigation import navigation_context
from journeykit.operators.sequence_facts import sequence_session_facts
from journeykit.operators.sessions import session_facts
from journeykit.operators.transitions import page_transitions
from journeykit.operators.url_params import url_params


def _by_session(df):
    return {r.session_id: r for r in df.collect()}


def test_session_facts_edge(spark):
    facts = _by_session(session_facts(flat_from_rows(spark)))
    e1 = facts["E1"]
    assert e1.journey_path == "Homepage -> Homepage -> ProductDetail -> Other -> CategoryPage -> Cart"
    assert e1.journey_steps == 6
    assert e1.journey_duration_seconds == 5.0
    assert e1.entry_page_template == "Homepage"
    assert e1.traffic_source_first == "google" and e1.traffic_medium_first == "organic"
    assert e1.saw_product_detail and e1.has_conversion
    e2 = facts["E2"]
    assert e2.journey_path == "Homepage -> Cart"  # tie on time broken by hit number
    assert e2.primary_device_type == "desktop"    # tie on count -> smallest value
    assert facts["E3"].primary_device_type is None  # NULL counted as a value


def test_navigation_edge(spark):
    nav = navigation_context(flat_from_rows(spark))
    e1 = {r.event_seq_num: r for r in nav.filter(F.col("session_id") == "E1").collect()}
    # 2 = refresh, 4 = NULL url, 5 = previous url NULL
    assert sorted(e1) == [1, 3, 6]
    assert all(r.session_event_cnt == 6 for r in e1.values())
    assert (e1[3].prev_page_template, e1[3].two_ahead_page_template, e1[3].next_page_template) == \
        ("Homepage", "Homepage", "Other")
    assert (e1[6].prev_page_template, e1[6].two_ahead_page_template, e1[6].next_page_template) == \
        ("CategoryPage", "Other", "N/A")
    assert (e1[1].prev_page_template, e1[1].two_ahead_page_template, e1[1].url_lag) == ("N/A", "N/A", "N/A")
    assert e1[1].first_page_template == "Homepage" and e1[1].last_page_template == "Cart"
    assert e1[3].param_pairs == ["x=1", "y=2+3"]


def test_sequence_facts_edge(spark):
    nav = navigation_context(flat_from_rows(spark))
    facts = _by_session(sequence_session_facts(nav))
    e1 = facts["E1"]
    assert e1.journey_fingerprint_str == "Homepage > ProductDetail > Cart"
    assert e1.journey_fingerprint_first_five_str == "Homepage > ProductDetail > Cart"
    assert e1.event_cnt == 3 and e1.conversion_cnt == 1 and e1.had_conversion


def test_url_params_edge(spark):
    nav = navigation_context(flat_from_rows(spark))
    params = url_params(nav).filter(F.col("session_id") == "E1")
    rows = sorted((r.event_seq_num, r.param_name, r.param_value) for r in params.collect())
    assert rows == [(1, None, None), (3, "x", "1"), (3, "y", "2 3"), (6, None, None)]
    pd_rows = params.filter(F.col("page_template") == "ProductDetail").count()
    assert pd_rows == 2  # event x parameter grain


def test_param_parsing(spark):
    from journeykit.operators.navigation import PARAM_PAIR_PATTERN
    from journeykit.operators.url_params import PARAM_NAME_PATTERN, PARAM_VALUE_PATTERN

    df = spark.createDataFrame([("https://h/p?q&r=1&a=&b=x=y&c=1+2#f",), ("https://h/p",)], "url STRING")
    pairs = df.select("url", F.explode_outer(F.regexp_extract_all("url", F.lit(PARAM_PAIR_PATTERN), 1)).alias("p"))
    out = pairs.select(
        "url",
        F.regexp_extract("p", PARAM_NAME_PATTERN, 1).alias("n"),
        F.replace(F.regexp_extract("p", PARAM_VALUE_PATTERN, 1), F.lit("+"), F.lit(" ")).alias("v"),
    ).collect()
    got = sorted((r.url.endswith("/p"), r.n, r.v) for r in out)
    assert got == [(False, "b", "x=y"), (False, "c", "1 2#f"), (False, "q&r", "1"), (True, None, None)]


def test_trigram_keeps_refresh_neighbours(spark):
    rows = [("S", 1, 1, "/a", "d", "(direct)", "(none)", False),
            ("S", 2, 2, "/a", "d", "(direct)", "(none)", False),
            ("S", 3, 3, "/b/c", "d", "(direct)", "(none)", False)]
    nav = navigation_context(flat_from_rows(spark, rows))
    got = {r.page_template_transition: r.transitions_count for r in page_transitions(nav, 3).collect()}
    assert got == {"N/A > N/A > TopCategory": 1, "TopCategory > TopCategory > CategoryPage": 1}


def test_enriched_equals_join(spark):
    nav = navigation_context(flat_from_rows(spark))
    enriched = enriched_events(nav)
    joined = url_params(nav).join(sequence_session_facts(nav).drop("entry_page_traffic_source_session_lvl"),
                                  "session_id", "left")
    cols = sorted(enriched.columns)
    assert cols == sorted(joined.columns)
    assert sorted(map(tuple, enriched.select(cols).collect()), key=repr) == \
        sorted(map(tuple, joined.select(cols).collect()), key=repr)
