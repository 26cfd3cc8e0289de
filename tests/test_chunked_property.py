"""Property test: chunked windows equal plain windows on random groups with
ties, NULL order values and NULL payloads, for random chunk sizes."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from journeykit.operators.sequence import no_chunks, ordered_context, plan_chunks

SPEC = dict(row_number="rn", lags=[("l1", "v", 1, None), ("l2", "v", 2, "none")],
            leads=[("n1", "v", 1, "end"), ("n2", "v", 2, None)],
            firsts=[("f", "v")], lasts=[("z", "v")], counts=[("c", "v")])

group = st.tuples(
    st.sampled_from(["a", "b", "c", None]),
    st.one_of(st.none(), st.integers(0, 6)),     # order column with ties / NULLs
    st.one_of(st.none(), st.sampled_from(["p", "q", "r"])),
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(group, min_size=1, max_size=60), chunk=st.integers(1, 9))
def test_random_groups(spark, rows, chunk):
    data = [(g, t, i, v) for i, (g, t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "g STRING, t BIGINT, h BIGINT, v STRING")
    plain = ordered_context(df, no_chunks(["g"], ["t", "h"]), **SPEC)
    chunked = ordered_context(df, plan_chunks(df, ["g"], ["t", "h"], rows_per_chunk=chunk), **SPEC)
    key = repr
    assert sorted(map(tuple, chunked.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
