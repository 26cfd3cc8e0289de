"""Plan shape of every key on the default path (no hot sessions): one scan,
at most one exchange on session_id, no sort-merge / nested-loop / cartesian
join, the event scan reads only the columns it needs."""

import re

import pytest

import __spark_entry__ as entry
from journeykit.operators.flatten import preprocess_hits
from journeykit.plans.catalog import QUERY_BUILDERS, JourneyData, query_catalog
from journeykit.sources.visits import load_visits
from conftest import SF_SMALL

KEYS = sorted(query_catalog())
FORBIDDEN = ["SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


#: Keys that save the rows first: their plan reads the saved files, a table
#: of the plain sessions and one of the hot ones.
FROM_SHARDS = [k for k in KEYS if k.endswith("_from_shards")]
FROM_TABLE = [k for k in KEYS if k.endswith("_from_table")]
DERIVED = [k for k in KEYS if k not in FROM_SHARDS + FROM_TABLE + ["session_facts_incremental"]]

#: Q2-Q4, Q7, Q8, Q10, Q11, Q13, Q14: session facts without the ordered path.
PATH_FREE = ["source_medium_single_product", "traffic_medium_frequency", "traffic_source_frequency", "bounce_non_google",
             "conversion_totals", "homepage_entry_outcomes", "category_entry_outcomes", "medium_performance",
             "channel_group_performance"]


@pytest.mark.parametrize("key", DERIVED)
def test_plan_shape(spark, key):
    plan = _plan(entry.queries()[key](spark, SF_SMALL))
    for op in FORBIDDEN:
        assert op not in plan, (key, op)
    assert plan.count("FileScan parquet") == 1, key
    assert plan.count("Exchange hashpartitioning(session_id") <= 1, key
    assert plan.count("Exchange hashpartitioning(user_id") <= 1, key
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    for schema in read:
        assert "value" not in schema and "props" not in schema, (key, schema)


def _jobs(spark, name, build) -> int:
    """Number of Spark jobs until the query is built."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("key", PATH_FREE + ["enriched_events", "navigation_context", "traffic_by_source", "category_frequency"])
def test_no_job_before_the_query(spark, key):
    """Once the sizes of the files are known, building a query reads no more
    than the files' schema; running it is its only read."""
    entry.queries()["conversion_totals"](spark, SF_SMALL)
    schema = _jobs(spark, f"schema-{key}", lambda: spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    assert _jobs(spark, f"build-{key}", lambda: entry.queries()[key](spark, SF_SMALL)) == schema


@pytest.mark.parametrize("key", PATH_FREE)
def test_path_free_keys_ask_no_sizes(spark, key):
    """Also from flat events of unknown sizes: no size pass, and no path in the plan."""
    flat = preprocess_hits(load_visits(spark, SF_SMALL))
    data = JourneyData.from_flat(flat)
    built = []
    assert _jobs(spark, f"flat-{key}", lambda: built.append(QUERY_BUILDERS[key](data))) == 0
    assert "listagg" not in _plan(built[0]).lower() and "plan" not in data._cache


def test_enrichment_is_one_pass(spark):
    """C7, Q24 and Q25: one exchange on the session, one sort of it, no join; Q24 and Q25 take no parameter apart."""
    for key in ("enriched_events", "traffic_by_source", "entry_traffic_by_source"):
        plan = _plan(entry.queries()[key](spark, SF_SMALL))
        assert "Join" not in plan, key
        assert len(re.findall(r"Sort \[session_id#\d+ ASC", plan)) == 1, key
        if key != "enriched_events":
            assert "param_pairs" not in plan, key
            assert not re.search(r"Exchange hashpartitioning\([^)]*session_id[^)]*\)", plan.replace(
                "Exchange hashpartitioning(session_id", "first exchange(", 1)), key


def test_sample_session_windows_one_session(spark):
    """The chosen id is a literal below the windows."""
    plan = _plan(entry.queries()["sample_session"](spark, SF_SMALL))
    lines = plan.split("\n")
    lowest_window = max(i for i, line in enumerate(lines) if "Window" in line and "session" in line)
    assert any(re.search(r"Filter.*= [0-9]+-[0-9]+", line) or "EqualTo" in line for line in lines[lowest_window:])


@pytest.mark.parametrize("key", FROM_TABLE)
def test_saved_tables_need_no_session_exchange(spark, key):
    plan = _plan(entry.queries()[key](spark, SF_SMALL))
    assert "Exchange hashpartitioning(session_id" not in plan.split("Union")[0]
    assert len(re.findall(r"FileScan parquet \S*flat_events_[0-9a-f]{32}\[", plan)) == 1 and "user_id" not in plan


@pytest.mark.parametrize("key", FROM_SHARDS)
def test_saved_shards_are_read_once(spark, key):
    plan = _plan(entry.queries()[key](spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 1 and "user_id" not in plan
    if key.startswith("preprocess_hits"):
        assert "PartitionFilters: [isnotnull(date" in plan


def test_incremental_facts_read_states_only(spark):
    plan = _plan(entry.queries()["session_facts_incremental"](spark, SF_SMALL))
    assert "user_id" not in plan and "hits" not in plan
