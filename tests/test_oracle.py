"""Every catalog key against its DuckDB oracle (row count, column names,
order-insensitive value hash), as the driver checks it."""

import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE, SF_SMALL
from journeykit.plans.catalog import query_catalog
from oracle_compare import compare, duck_connect

KEYS = sorted(query_catalog())


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_ORACLE)


def test_every_query_has_oracle():
    assert set(KEYS) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    res = compare(entry.queries()[key](spark, SF_ORACLE), duck, entry.oracle_sql()[key])
    assert res["hash_match"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["channel_group", "session_count", "avg_journey_steps",
                          "avg_duration_sec", "conversion_rate_pct"]
    res = compare(df, duck_connect(SF_SMALL), entry.oracle_sql()["channel_group_performance"])
    assert res["hash_match"], res


@pytest.mark.parametrize("key,rule,instead", [
    ("session_facts", "event_seq_num ASC NULLS FIRST", "event_seq_num DESC"),         # ties on time
    ("session_facts", "ORDER BY count(*) DESC, device_type", "ORDER BY count(device_type) DESC, device_type"),
    ("navigation_context", "WHERE keep_row", "WHERE keep_row IS NOT FALSE"),          # NULL URLs are dropped
    ("navigation_context", "WHERE keep_row", ""),                                     # so are refreshes
    ("session_facts", "GROUP BY f.session_id", "WHERE f.session_id IS NOT NULL GROUP BY f.session_id"),
])
def test_fixture_tells_rules_apart(duck, key, rule, instead):
    """Without the rule the expected rows are others: the fixture can fail it."""
    sql = entry.oracle_sql()[key]
    assert rule in sql
    names = [d[0] for d in duck.execute(sql).description]
    wanted = ", ".join(f"CAST({n} AS VARCHAR)" for n in names)
    found = [sorted(duck.execute(f"SELECT {wanted} FROM ({s})").fetchall(), key=repr)
             for s in (sql, sql.replace(rule, instead))]
    assert found[0] != found[1]
