"""Cross-query invariants on the sf0.001 tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from journeykit.plans.catalog import JourneyData
from journeykit.plans import analyses as A


def test_invariants(spark):
    d = JourneyData.from_testdata(spark, SF_SMALL)
    flat_rows = d.flat.count()
    # every flat row is one step of exactly one session path
    assert d.facts.agg(F.sum("journey_steps")).first()[0] == flat_rows
    # journey_frequency (sessions) = session count by journey (distinct sessions)
    q20 = {r[0]: r[1] for r in A.journey_fingerprint_frequency(d.seq_facts.where("session_id IS NOT NULL")).collect()}
    q26 = {r[0]: r[1] for r in A.sessions_by_journey(d.seq_facts).collect()}
    assert q26.pop(None) == 0  # the rows without a session id
    assert q20 == q26
    # enriched rows = sum over events of max(1, number of parameters)
    expected = d.navigation.agg(F.sum(F.greatest(F.size("param_pairs"), F.lit(1)))).first()[0]
    assert A.enriched_event_count(d.params).first()[0] == expected
    # category shares add up to one (fewer than 100 categories)
    assert abs(A.category_frequency(d.params).agg(F.sum("cnt_pct")).first()[0] - 1.0) < 1e-9
    # refresh removal only removes rows
    assert d.navigation.count() <= flat_rows
