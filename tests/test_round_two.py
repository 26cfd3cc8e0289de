"""Hot NULL keys, long sessions, bucketed files and a restarted stream."""

import glob
import inspect
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from journeykit.operators.enrich import enriched_events
from journeykit.operators.flatten import preprocess_hits
from journeykit.operators.sequence import no_chunks, ordered_context, plan_chunks
from journeykit.plans import analyses
from journeykit.plans.catalog import JourneyData
from journeykit.sources.tables import write_by_session, write_flat_events
from journeykit.sources.visits import load_visits, write_visits
from journeykit.streaming import stream_flat_events


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_null_group_is_split(spark):
    rows = [(None, i // 2, i, f"v{i % 5}") for i in range(300)] + [("s", 1, 1, "x"), ("s", 2, 2, None)]
    df = spark.createDataFrame(rows, "g STRING, t BIGINT, h BIGINT, v STRING")
    spec = dict(row_number="rn", lags=[("l", "v", 1, "start")], leads=[("n", "v", 1, "end")], firsts=[("f", "v")],
                lasts=[("z", "v")], counts=[("c", "v")])
    plan = plan_chunks(df, ["g"], ["t", "h"], rows_per_chunk=20)
    assert plan.n_hot == 1 and plan.n_chunks >= 12
    chunked = ordered_context(df, plan, keep_chunk=True, **spec)
    largest = chunked.groupBy("g", "_chunk").count().agg(F.max("count")).first()[0]
    assert largest <= 60
    assert _rows(chunked.drop("_chunk", "_hot")) == _rows(ordered_context(df, no_chunks(["g"], ["t", "h"]), **spec))


@pytest.mark.parametrize("time", [None, 7])
def test_block_of_one_time_is_split(spark, time):
    rows = [("h", time, i, f"v{i % 5}") for i in range(300)] + [("h", 8 + i, i, "x") for i in range(30)] + [("s", 1, 1, "x")]
    df = spark.createDataFrame(rows, "g STRING, t BIGINT, h BIGINT, v STRING")
    spec = dict(row_number="rn", lags=[("l", "v", 2, "start")], leads=[("n", "v", 1, "end")], firsts=[("f", "v")],
                lasts=[("z", "v")], counts=[("c", "v")])
    chunked = ordered_context(df, plan_chunks(df, ["g"], ["t", "h"], rows_per_chunk=20), keep_chunk=True, **spec)
    assert chunked.groupBy("g", "_chunk").count().agg(F.max("count")).first()[0] <= 60
    assert _rows(chunked.drop("_chunk", "_hot")) == _rows(ordered_context(df, no_chunks(["g"], ["t", "h"]), **spec))


def test_long_session_enrichment_is_a_join(spark):
    one = preprocess_hits(load_visits(spark, SF_SMALL)).limit(1)
    flat = (one.crossJoin(spark.range(8000)).withColumn("trace_time", F.col("trace_time") + F.col("id"))
            .withColumn("event_seq_num", F.col("id") + 1)
            .withColumn("url", F.concat(F.lit("https://h/a"), F.col("id") % 7)).drop("id"))
    data = JourneyData.from_flat(flat)
    rows = enriched_events(data.nav_chunked)
    assert rows.count() == 8000
    assert rows.select("event_cnt").distinct().collect()[0][0] == 8000
    assert [r["cnt"] for r in analyses.sessions_by_journey(data.seq_facts).collect()] == [1]


def test_bucketed_table_has_a_file_per_bucket(spark):
    flat = preprocess_hits(load_visits(spark, SF_SMALL)).repartition(16)
    path = tempfile.mkdtemp(prefix="jk-buckets-", dir="/tmp")
    write_flat_events(flat, "flat_events_files", buckets=8, path=os.path.join(path, "t"))
    assert len(glob.glob(os.path.join(path, "t", "part-*"))) <= 8
    assert spark.table("flat_events_files").count() == flat.count()
    spark.sql("DROP TABLE flat_events_files")


def test_stream_restart_takes_new_shards(spark):
    assert inspect.signature(stream_flat_events).parameters["checkpoint_path"].default is inspect.Parameter.empty
    base = tempfile.mkdtemp(prefix="jk-restart-", dir="/tmp")
    src, sink, ckpt = (os.path.join(base, n) for n in ("src", "sink", "ckpt"))
    visits = load_visits(spark, SF_SMALL)
    early = F.col("date") < "20240110"
    write_visits(visits.where(early), src)
    stream_flat_events(spark, src, sink, ckpt).awaitTermination(300)
    first = spark.read.parquet(sink).count()
    visits.where(~early).write.mode("append").partitionBy("date").parquet(src)
    stream_flat_events(spark.newSession(), src, sink, ckpt).awaitTermination(300)
    flat = preprocess_hits(visits)
    assert first == preprocess_hits(visits.where(early)).count() < flat.count()
    assert _rows(spark.read.parquet(sink).select(flat.columns)) == _rows(flat)


@pytest.mark.parametrize("build", ["navigation", "seq_facts", "enriched"])
def test_production_entries_give_the_same_rows(spark, build):
    base = os.path.join(tempfile.mkdtemp(prefix="jk-entry-", dir="/tmp"), "src")
    visits = load_visits(spark, SF_SMALL)
    write_visits(visits, base)
    data = JourneyData.from_visits(spark, base, "20240101", "20240131")
    direct = JourneyData(visits)
    flat = JourneyData.from_flat(preprocess_hits(visits))
    want = _rows(getattr(direct, build))
    assert _rows(getattr(data, build)) == want and _rows(getattr(flat, build)) == want


@pytest.mark.parametrize("rows_per_chunk", [None, 3])
def test_saved_navigation_serves_the_sequencing_keys(spark, rows_per_chunk):
    base, table = tempfile.mkdtemp(prefix="jk-saved-", dir="/tmp"), f"saved_steps_{rows_per_chunk}"
    direct = JourneyData.from_flat(preprocess_hits(load_visits(spark, SF_SMALL)), rows_per_chunk)
    write_by_session(direct.nav_chunked, table, buckets=4, path=os.path.join(base, "t"))
    data = JourneyData.from_saved(direct.flat, spark.table(table))
    for layer in ("navigation", "seq_facts", "enriched"):
        assert _rows(getattr(data, layer)) == _rows(getattr(direct, layer))
    assert "hashpartitioning(session_id" not in data.seq_facts._jdf.queryExecution().executedPlan().toString() or rows_per_chunk
    spark.sql(f"DROP TABLE {table}")
