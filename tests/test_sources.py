"""Nested source written as date shards, read back with the pruned schema."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from journeykit.operators.flatten import preprocess_hits
from journeykit.sources.visits import (
    HITS_PER_ROW, load_visits, read_visits, write_visits,
)
from journeykit.sources.tables import read_table, write_flat_events


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_shards_roundtrip_and_pruning(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="jk-src-", dir="/tmp"), "visits")
    sessions = load_visits(spark, SF_SMALL)
    write_visits(sessions, out)
    back = read_visits(spark, out)
    # same flat rows from the written shards as from the in-memory source
    a = preprocess_hits(sessions)
    b = preprocess_hits(back)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    # a date range prunes whole folders and the scan reads only needed fields
    ranged = preprocess_hits(back, "20240103", "20240105")
    plan = _plan(ranged)
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "adContent" in plan  # the pruned read schema is the one given
    dates = {r.date for r in back.filter(F.col("date").between("20240103", "20240105")).select("date").distinct().collect()}
    assert dates and all("20240103" <= x <= "20240105" for x in dates)
    assert ranged.count() < a.count()


def test_hits_per_row_is_bounded(spark):
    sessions = load_visits(spark, SF_SMALL)
    assert sessions.agg(F.max(F.size("hits"))).first()[0] <= HITS_PER_ROW


def test_bucketed_flat_table(spark):
    from journeykit.operators.sessions import session_facts

    flat = preprocess_hits(load_visits(spark, SF_SMALL))
    folder = tempfile.mkdtemp(prefix="jk-tbl-", dir="/tmp")
    write_flat_events(flat, "jk_flat_events", buckets=4, path=folder)
    table = read_table(spark, "jk_flat_events")
    assert table.count() == flat.count()
    # sessions aggregated straight off the buckets: no exchange below the aggregate
    plan = _plan(session_facts(table))
    assert "Exchange hashpartitioning(session_id" not in plan
    spark.sql("DROP TABLE IF EXISTS jk_flat_events")


def test_analyses_from_bucketed_table(spark):
    """Production path: flat events saved bucketed by session, analyses read
    the table; the navigation windows need no exchange on session_id."""
    from journeykit.plans.catalog import JourneyData
    from journeykit.plans import analyses as A

    flat = preprocess_hits(load_visits(spark, SF_SMALL))
    folder = tempfile.mkdtemp(prefix="jk-tbl2-", dir="/tmp")
    write_flat_events(flat, "jk_flat_events2", buckets=4, path=folder)
    data = JourneyData.from_flat(read_table(spark, "jk_flat_events2"))
    nav_plan = _plan(data.navigation)
    assert "Exchange hashpartitioning(session_id" not in nav_plan
    expected = {r[0]: r[1] for r in A.channel_group_performance(
        JourneyData.from_flat(flat).facts).select("channel_group", "session_count").collect()}
    got = {r[0]: r[1] for r in A.channel_group_performance(data.facts)
           .select("channel_group", "session_count").collect()}
    assert got == expected
    spark.sql("DROP TABLE IF EXISTS jk_flat_events2")


def test_analyses_from_visit_files(spark):
    """Production path from the nested files: date range as partition filter."""
    from journeykit.plans.catalog import JourneyData
    from journeykit.plans import analyses as A

    out = os.path.join(tempfile.mkdtemp(prefix="jk-src3-", dir="/tmp"), "visits")
    write_visits(load_visits(spark, SF_SMALL), out)
    data = JourneyData.from_visits(spark, out, "20240101", "20240110")
    result = A.channel_group_performance(data.facts)
    assert "PartitionFilters: [isnotnull(date" in _plan(result)
    total = sum(r.session_count for r in result.collect())
    assert 0 < total < JourneyData.from_visits(spark, out).facts.count()
