"""Differential test of the session and sequencing layers on random flat
events — time ties and NULL times, NULL and repeated URLs (refreshes), NULL
devices and sources — against the oracle's SQL run by DuckDB on the same
rows. Chunking is forced on in half of the examples."""

import os

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fixtures import flat_from_rows
from journeykit.operators.enrich import enriched_events
from journeykit.operators.navigation import navigation_context
from journeykit.operators.sequence import no_chunks, session_plan
from journeykit.operators.sequence_facts import sequence_session_facts
from journeykit.operators.sessions import session_facts
from journeykit.plans import oracle
from oracle_compare import canonical, digest

ORDER = ["trace_time", "event_seq_num"]
PATHS = ["/", "/home", "/a", "/a/b", "/a/b/c?x=1&y=2+3", "/basket.html", "/signin", None]
event = st.tuples(
    st.sampled_from(["s1", "s2", "s3"]),
    st.one_of(st.none(), st.integers(0, 5)),          # trace_time: ties and NULLs
    st.sampled_from(PATHS),
    st.sampled_from(["desktop", "mobile", None]),
    st.sampled_from(["google", "(direct)", "t.co", None]),
    st.sampled_from(["organic", "cpc", None]),
    st.booleans(),
)


def _same(spark_df, con, sql):
    sc, sr = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    dc, dr = canonical(rel.columns, rel.fetchall())
    assert sc == dc
    assert digest(sr) == digest(dr), (sr, dr)


@settings(max_examples=int(os.environ.get("SEQ_EXAMPLES", "8")), deadline=None,
          suppress_health_check=list(HealthCheck))
@given(events=st.lists(event, min_size=1, max_size=30), chunked=st.booleans())
def test_layers_agree_with_sql(spark, events, chunked):
    rows = [(s, t, i + 1, p, d, src, med, conv) for i, (s, t, p, d, src, med, conv) in enumerate(events)]
    flat = flat_from_rows(spark, rows)
    plan = session_plan(flat, rows_per_chunk=2) if chunked else no_chunks(["session_id"], ORDER)
    con = duckdb.connect()
    con.register("flat_df", flat.toArrow())
    con.execute("CREATE TABLE flat AS SELECT * FROM flat_df")

    def sql(*layers, select):
        return "WITH " + ",".join(layers) + "\n" + select

    _same(session_facts(flat, plan=plan), con,
          sql(oracle._FACTS, select=f"SELECT {oracle._FACT_COLS} FROM facts"))
    nav = navigation_context(flat, plan, keep_chunk=plan.active)
    public_nav = nav.select(*[c for c in nav.columns if not c.startswith("_")])
    _same(public_nav, con, sql(oracle._NAV, select="SELECT * FROM nav"))
    _same(sequence_session_facts(nav), con, sql(oracle._NAV, oracle._SEQ, select="SELECT * FROM seq_facts"))
    _same(enriched_events(nav), con,
          sql(oracle._NAV, oracle._PARAMS, oracle._SEQ, oracle._ENRICHED, select="SELECT * FROM enriched"))
