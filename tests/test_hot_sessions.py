"""Chunk boundaries by range sketch, the size manifest, the split tables, and
majorities from counts: each with a third of the rows in one session, or in
the session without an id."""

import glob
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from journeykit.functions.columns import majority_value
from journeykit.operators.enrich import enriched_events, events_with_facts
from journeykit.operators.flatten import preprocess_hits
from journeykit.operators.incremental import facts_from_states, read_states, save_states, session_states
from journeykit.operators.navigation import navigation_context
from journeykit.operators.sequence import (group_sizes, no_chunks, ordered_context, plan_chunks, ranked_in_groups, session_plan,
                                           with_chunks)
from journeykit.operators.sessions import hot_majority, session_facts
from journeykit.plans.catalog import JourneyData
from journeykit.sources.manifest import read_manifest, recorded_states, session_sizes, shard_states, update_manifest
from journeykit.sources.tables import hot_table, write_split_by_session
from journeykit.sources.visits import known_largest_groups, load_visits, read_visits, write_visits

EVENTS = ["trace_time", "event_seq_num"]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _folder(name):
    return os.path.join(tempfile.mkdtemp(prefix="jk-hot-", dir="/tmp"), name)


@pytest.fixture(scope="module")
def skewed(spark):
    """Flat events of which more than a third are of one session and a third have no session id."""
    flat = preprocess_hits(load_visits(spark, SF_SMALL)).where("session_id is not null").limit(400)
    n = F.col("id")
    hot = flat.limit(1).crossJoin(spark.range(900)).withColumn("trace_time", F.col("trace_time") + F.floor(n / 5))
    hot = (hot.withColumn("event_seq_num", n + 1).withColumn("url", F.when(n % 11 != 0, F.concat(F.lit("https://h/a?x="), n % 4)))
           .withColumn("page_template", F.element_at(F.array(*map(F.lit, ("Homepage", "Cart", "Other"))), (n % 3 + 1).cast("int")))
           .withColumn("device_type", F.when(n % 3 != 0, F.concat(F.lit("d"), n % 7))))
    nameless = hot.withColumn("session_id", F.lit(None).cast("string"))
    named = hot.withColumn("session_id", F.lit("hot-1"))
    return flat.unionByName(named.drop("id")).unionByName(nameless.drop("id")).repartition(6).checkpoint()


# ---- boundaries ---------------------------------------------------------------

def test_ranks_across_ranges(spark):
    rows = [("a", i % 37, i) for i in range(500)] + [(None, None, i) for i in range(50)] + [("b", 1, 1)]
    df = spark.createDataFrame(rows, "g STRING, t INT, s INT").repartition(5)
    got = ranked_in_groups(df, ["g"], ["t", "s"]).collect()
    for g in ("a", "b", None):
        own = sorted([r for r in got if r["g"] == g], key=lambda r: r["_rank"])
        assert [r["_rank"] for r in own] == list(range(len(own))) and {r["_size"] for r in own} == {len(own)}
        assert [(r["t"] or 0, r["s"]) for r in own] == sorted((r["t"] or 0, r["s"]) for r in own)


def test_many_chunks_are_planned_in_seconds(spark):
    """300,000 chunks in one group: boundaries are rows, no expression grows with them."""
    df = spark.range(0, 600_000, 1, 8).select(F.lit("g").alias("g"), F.xxhash64("id").alias("t"), F.col("id").alias("h"))
    started = time.monotonic()
    plan = plan_chunks(df, ["g"], ["t", "h"], rows_per_chunk=2)
    chunked = with_chunks(df, plan).groupBy("_chunk").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert time.monotonic() - started < 90
    assert plan.n_chunks == 300_000 and tuple(chunked) == (2, 300_000)


def test_sampled_chunks_are_even(spark):
    """Above the sampling rate chunks are near the size asked for, in blocks of one time too."""
    df = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 3 != 0, F.lit("hot")).alias("g"), F.floor(F.col("id") / 60_000).alias("t"), F.col("id").alias("h"))
    plan = plan_chunks(df, ["g"], ["t", "h"], rows_per_chunk=5000)
    sizes = [r["count"] for r in with_chunks(df, plan).groupBy("g", "_chunk").count().collect()]
    assert plan.n_hot == 2 and 35 <= len(sizes) <= 41 and max(sizes) < 12_500


def test_sizes_may_be_given_and_too_large(spark, skewed):
    """Groups named hot that are not are cut without a change of results, and no counting is done."""
    sizes = spark.createDataFrame([(r["session_id"], r["_n"] + 500) for r in group_sizes(skewed, ["session_id"]).collect()],
                                  "session_id STRING, _n BIGINT")
    plan = session_plan(skewed, 100, sizes)
    assert plan.n_hot == sizes.count()
    assert _rows(navigation_context(skewed, plan)) == _rows(navigation_context(skewed, no_chunks(["session_id"], EVENTS)))


# ---- facts --------------------------------------------------------------------

def test_enrichment_of_hot_sessions(spark, skewed):
    """Windows for the sessions that fit a task, a join for the others: the same rows."""
    plain = navigation_context(skewed, no_chunks(["session_id"], EVENTS), keep_hit=True)
    chunked = navigation_context(skewed, session_plan(skewed, 100), keep_chunk=True)
    assert _rows(enriched_events(chunked)) == _rows(enriched_events(plain))
    without_hit = navigation_context(skewed, no_chunks(["session_id"], EVENTS))
    assert _rows(enriched_events(without_hit)) == _rows(enriched_events(plain))
    facts = {r["session_id"]: r for r in JourneyData.from_flat(skewed, 100).seq_facts.collect()}
    for r in events_with_facts(plain).collect():
        own = facts[r["session_id"]]
        if r["session_id"] is None:
            assert r["event_cnt"] is None and r["journey_fingerprint_str"] is None
        else:
            assert all(r[c] == own[c] for c in ("event_cnt", "journey_fingerprint_str", "primary_device_type",
                                                "primary_traffic_source", "entry_page_source", "conversion_cnt"))


def test_majority_from_counts(spark):
    """A session of many values, ties, and NULL as the most frequent value."""
    rows = ([("many", f"v{i}") for i in range(5000)] + [("many", "v17"), ("tie", "b"), ("tie", "a"), ("null", None), ("null", None),
            ("null", "x"), ("nulltie", None), ("nulltie", "x"), (None, "n")])
    df = spark.createDataFrame(rows, "session_id STRING, v STRING").withColumn("_hot", F.lit(True))
    got = {r["session_id"]: r["m"] for r in hot_majority(df, "v", "m").collect()}
    want = {r["session_id"]: r["m"] for r in df.groupBy("session_id").agg(majority_value("v").alias("m")).collect()}
    assert got == want == {"many": "v17", "tie": "a", "null": None, "nulltie": None, None: "n"}


def test_majority_of_more_groups_than_a_hash_map_takes(spark):
    """Beyond 128 groups an aggregate goes on with sorted, spilled buffers: counts of before and after must meet."""
    rows = spark.range(0, 6000, 1, 2).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 900).cast("string").alias("session_id"),
        F.when(F.col("id") % 7 > 3, F.concat(F.lit("d"), F.col("id") % 5)).alias("v")).collect()
    df = spark.createDataFrame(rows, "session_id STRING, v STRING").repartition(2)
    got = {r["session_id"]: r["m"] for r in df.groupBy("session_id").agg(majority_value("v").alias("m")).collect()}
    counts = {}
    for r in rows:
        own = counts.setdefault(r["session_id"], {})
        own[r["v"]] = own.get(r["v"], 0) + 1
    assert got == {s: min(own, key=lambda v: (-own[v], v is not None, v or "")) for s, own in counts.items()}


def test_facts_of_hot_sessions(spark, skewed):
    plain, hot = session_facts(skewed), session_facts(skewed, plan=session_plan(skewed, 100))
    assert _rows(hot) == _rows(plain)
    without = session_facts(skewed, with_path=False)
    assert "journey_path" not in without.columns and _rows(without) == _rows(plain.drop("journey_path"))


# ---- split tables -------------------------------------------------------------

def test_split_tables(spark, skewed):
    """Two thirds of the rows are of two sessions: they are written by as many tasks as there are buckets, apart from the
    others, and every layer reads the same rows from the two tables as from the events."""
    name, path = "jk_split", _folder("t")
    write_split_by_session(skewed, name, session_plan(skewed, 100), buckets=8, path=path)
    plain, hot = spark.table(name), spark.table(hot_table(name))
    assert hot.count() == 1800 and {r[0] for r in hot.select("session_id").distinct().collect()} == {"hot-1", None}
    assert plain.where("session_id is null or session_id = 'hot-1'").count() == 0
    assert len(glob.glob(f"{path}_hot/part-*")) == 8
    shares = [r["count"] for r in hot.groupBy(F.input_file_name()).count().collect()]
    assert max(shares) < 700
    saved, direct = JourneyData.from_split(spark, name), JourneyData.from_flat(skewed, 10**6)
    for layer in ("flat", "facts", "facts_without_path", "first_touch", "navigation", "params", "seq_facts", "enriched", "flags"):
        assert _rows(getattr(saved, layer).select(getattr(direct, layer).columns)) == _rows(getattr(direct, layer)), layer
    nav = saved.plain.navigation._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in nav
    # the saved rows of hot sessions are not shuffled either, only the few repair rows are
    lines = saved.hot.nav_chunked._jdf.queryExecution().executedPlan().toString().split("\n")
    depths = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            assert not any("FileScan" in x for x in lines[i + 1:below])
    for table in (name, hot_table(name)):
        spark.sql(f"DROP TABLE {table}")


def test_split_without_hot_sessions(spark):
    flat = preprocess_hits(load_visits(spark, SF_SMALL))
    name = "jk_split_plain"
    write_split_by_session(flat, name, session_plan(flat), buckets=4, path=_folder("t"))
    assert spark.table(hot_table(name)).count() == 0
    assert _rows(JourneyData.from_split(spark, name).facts) == _rows(session_facts(flat, with_duration_ms=True))
    for table in (name, hot_table(name)):
        spark.sql(f"DROP TABLE {table}")


# ---- manifest -----------------------------------------------------------------

def test_manifest_finds_large_sessions(spark):
    path, visits = _folder("v"), load_visits(spark, SF_SMALL)
    write_visits(visits, path)
    assert session_sizes(spark, path, None, None, 10) is None                     # nothing is recorded yet
    shards = sorted(shard_states(spark, path))
    assert update_manifest(spark, path, read_visits(spark, path), floor=2) == shards
    assert update_manifest(spark, path, read_visits(spark, path), floor=2) == []  # nothing is new
    assert recorded_states(read_manifest(spark, path)) == shard_states(spark, path)
    flat = preprocess_hits(visits)
    true = {r["session_id"]: r["_n"] for r in group_sizes(flat, ["session_id"]).collect()}
    for limit in (20, 40):
        told = {r["session_id"]: r["_n"] for r in session_sizes(spark, path, None, None, limit).collect()}
        assert {s for s, n in true.items() if n > limit} <= set(told) and all(told[s] >= true[s] for s in told)
    assert session_sizes(spark, path, None, None, 10) is None                     # the rests alone may pass 10
    # the shards are still read as data alone
    assert read_visits(spark, path).count() == visits.count()


def test_manifest_notices_changed_shards(spark):
    path, visits = _folder("v"), load_visits(spark, SF_SMALL)
    early = F.col("date") < "20240110"
    write_visits(visits.where(early), path, with_sizes=True)
    assert session_sizes(spark, path, None, None, 50_000) is not None
    write_visits(visits.where(~early), path, mode="append")
    assert session_sizes(spark, path, None, None, 50_000) is None
    assert session_sizes(spark, path, None, "20240109", 50_000) is not None       # the range holds old shards only
    new = update_manifest(spark, path, read_visits(spark, path))
    assert new and min(new) >= "20240110" and session_sizes(spark, path, None, None, 50_000) is not None


def test_layers_from_shards_with_manifest(spark):
    """A session across shards, and one without an id, are hot by the merged counts; the rows stay the same."""
    path, visits = _folder("v"), load_visits(spark, SF_SMALL)
    write_visits(visits, path)
    update_manifest(spark, path, read_visits(spark, path), floor=1)
    data = JourneyData.from_visits(spark, path)
    data.rows_per_chunk = 30
    assert data.plan.n_hot >= 1
    direct = JourneyData.from_flat(preprocess_hits(visits), 10**6)
    for layer in ("facts", "navigation", "enriched"):
        assert _rows(getattr(data, layer)) == _rows(getattr(direct, layer)), layer


def test_sizes_of_files_are_counted_once(spark):
    path = f"{SF_SMALL}/events.parquet"
    largest = known_largest_groups(spark, path)
    flat = preprocess_hits(load_visits(spark, SF_SMALL))
    assert largest.session >= group_sizes(flat, ["session_id"]).agg(F.max("_n")).first()[0]
    spark.sparkContext.setJobGroup("sizes-again", "sizes-again")
    known_largest_groups(spark, path)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sizes-again")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_windows_keep_first_and_last(spark, skewed):
    spec = dict(firsts=[("f", "page_template")], lasts=[("z", "url")], counts=[("c", "url")])
    plain = ordered_context(skewed, no_chunks(["session_id"], EVENTS), **spec)
    assert _rows(ordered_context(skewed, session_plan(skewed, 50), **spec)) == _rows(plain)


# ---- states -------------------------------------------------------------------

@pytest.mark.parametrize("parts", [1, 4])
def test_facts_from_states(spark, skewed, parts):
    """However the events are dealt over shards, also within one time, and with a shard saved twice: the same facts."""
    path = _folder("states")
    for i in range(parts):
        shard = skewed.where(F.pmod(F.xxhash64("session_id", "event_seq_num"), F.lit(parts)) == i)
        for _ in range(2 if i == 0 else 1):
            save_states(shard, path, f"s{i}")
    facts = facts_from_states(read_states(spark, path))
    assert _rows(facts) == _rows(session_facts(skewed).select(*facts.columns))


def test_states_of_a_new_day(spark):
    """The states of the days up to n and those of day n + 1 give the facts of all; sessions across midnight included."""
    flat = preprocess_hits(load_visits(spark, SF_SMALL))
    early = F.floor(F.col("trace_time") / 86_400_000) <= F.lit(19_730)
    both = flat.groupBy("session_id").agg(F.bool_or(early).alias("a"), F.bool_or(~early).alias("b"))
    assert both.where("a and b").count() > 0
    states = session_states(flat.where(early)).unionByName(session_states(flat.where(~early)))
    facts = facts_from_states(states)
    assert _rows(facts) == _rows(session_facts(flat).select(*facts.columns))
    assert facts_from_states(states.limit(0)).count() == 0
