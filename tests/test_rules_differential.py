"""Differential test of the classification rules: random page paths and
sources classified by Spark (Java regex, the Column rules) and by DuckDB
(RE2, the oracle's CASE) must agree."""

import duckdb
import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from journeykit.functions.rules import page_template, source_group
from journeykit.plans.oracle import PAGE_TEMPLATE_SQL, SOURCE_GROUP_SQL

TOKENS = ["", "/", "//", "home", "HOME", "index.html", "default.aspx", "a", "bags", "cart", "Basket",
          "checkout", "payment", "thank-you", "ordercompleted", "search", "asearch", "quickview",
          "store", "locator", "store-locator", "signin", "LogIn", "register", "app.js", "x.css",
          "img.PNG", "tee.axd", "?", "&", "=", "q=", "keyword=", "query=1", "#f", ".", "-", "+", "\n"]

path = st.one_of(st.none(), st.lists(st.sampled_from(TOKENS), max_size=8).map("".join))
source = st.one_of(st.none(), st.lists(st.sampled_from(
    ["", "(direct)", "(not set)", "google", "GOOGLE", "m.", ".com", "bing", "facebook", "fb", "off",
     "beat", "twitter", "youtube", "instagram", "linkedin", "t.co", "Partners"]), max_size=3).map("".join))


@settings(max_examples=int(os.environ.get("RULE_EXAMPLES", "15")), deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(path, source), min_size=1, max_size=40))
def test_rules_agree_with_sql(spark, rows):
    data = [(i, p, s) for i, (p, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "i INT, page_path STRING, source STRING")
    got = {r.i: (r.t, r.g) for r in df.select(
        "i", page_template(F.col("page_path")).alias("t"), source_group(F.col("source")).alias("g")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE r (i INTEGER, page_path VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?)", data)
    want = {i: (t, g) for i, t, g in con.execute(
        f"SELECT i, {PAGE_TEMPLATE_SQL} AS t, {SOURCE_GROUP_SQL} AS g FROM r").fetchall()}
    assert got == want


URL_TOKENS = ["https://h/p", "?", "&", "=", "a", "b", "q", "x=y", "1", "+", "2", "#f", "/", "%20", "&&", "=="]


@settings(max_examples=int(os.environ.get("RULE_EXAMPLES", "15")), deadline=None,
          suppress_health_check=list(HealthCheck))
@given(urls=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(URL_TOKENS), max_size=10).map("".join)),
                     min_size=1, max_size=40))
def test_param_parsing_agrees_with_sql(spark, urls):
    """URL parameter pairs, names and values: Java regex in Spark = RE2 in
    DuckDB (the oracle's pair, name and value expressions)."""
    from journeykit.operators.navigation import PARAM_PAIR_PATTERN
    from journeykit.operators.url_params import PARAM_NAME_PATTERN, PARAM_VALUE_PATTERN

    data = [(i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(data, "i INT, url STRING")
    pairs = df.select("i", F.explode_outer(F.regexp_extract_all("url", F.lit(PARAM_PAIR_PATTERN), 1)).alias("p"))
    got = sorted((r.i, r.n, r.v) for r in pairs.select(
        "i",
        F.regexp_extract("p", PARAM_NAME_PATTERN, 1).alias("n"),
        F.replace(F.regexp_extract("p", PARAM_VALUE_PATTERN, 1), F.lit("+"), F.lit(" ")).alias("v"),
    ).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE u (i INTEGER, url VARCHAR)")
    con.executemany("INSERT INTO u VALUES (?, ?)", data)
    want = sorted(con.execute(r"""
        WITH p AS (
          SELECT i, unnest(CASE WHEN url IS NULL OR len(regexp_extract_all(url, '[?&]((?:[^=]+)=(?:[^&]+))', 1)) = 0
                                THEN [CAST(NULL AS VARCHAR)]
                                ELSE regexp_extract_all(url, '[?&]((?:[^=]+)=(?:[^&]+))', 1) END) AS pair
          FROM u)
        SELECT i, regexp_extract(pair, '([^=]+)', 1), replace(regexp_extract(pair, '[^=]+=([^&]+)', 1), '+', ' ')
        FROM p""").fetchall())
    assert got == want
