"""The nested web-visit source (one row per visit, repeated ``hits``).

Two ways in:

* ``read_visits`` — a Parquet directory partitioned by ``date`` (the
  date-sharded source); a pruned read schema keeps the scan to the fields the
  flattening reads, and the date range becomes a partition filter.
* ``visits_from_events`` — derives the nested source from the driver's
  ``events`` table with integer formulas that a SQL engine can repeat
  exactly (see FIXTURES.md §3). Its cost grows with ``events``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from journeykit.functions.columns import epoch_millis
from journeykit.operators.sequence import DEFAULT_ROWS_PER_CHUNK, group_sizes, no_chunks, ordered_context, plan_chunks
from journeykit.session import rows_per_chunk as configured_rows_per_chunk
from journeykit.sources.manifest import update_manifest

# Only the fields the flattening reads. Passing this as the read schema is
# what prunes the nested ``hits`` struct: Catalyst alone does not prune
# several sub-fields through ``explode``.
VISITS_DDL = (
    "fullVisitorId STRING, visitId BIGINT, visitStartTime BIGINT, date STRING, "
    "device STRUCT<deviceCategory: STRING>, "
    "trafficSource STRUCT<source: STRING, medium: STRING, campaign: STRING, "
    "adContent: STRING, keyword: STRING, adwordsClickInfo: STRUCT<gclid: STRING>>, "
    "hits ARRAY<STRUCT<hitNumber: BIGINT, time: BIGINT, type: STRING, "
    "page: STRUCT<pagePath: STRING, hostname: STRING>, "
    "product: ARRAY<STRUCT<v2ProductCategory: STRING>>, "
    "eCommerceAction: STRUCT<action_type: STRING>>>"
)

# ---------------------------------------------------------------------------
# Fixed values of the derived fixture (FIXTURES.md §3); the SQL oracle repeats
# them, so both engines build identical visits.
# ---------------------------------------------------------------------------
FIXTURE_EPOCH_MS = 1704067200000          # 2024-01-01 00:00:00 UTC
FIXTURE_VISIT_MS = 172800000              # two-day visit bucket
FIXTURE_HOST = "h.example"
FIXTURE_PATHS = [
    "/home", "/", "/store.html", "/google+redesign/apparel",
    "/google+redesign/apparel/mens", "/google+redesign/apparel/mens/tee.axd",
    "/google+redesign/bags/backpacks/home?utm_source=feed&color=dark+blue",
    "/google+redesign/electronics/audio/cam?sku=7", "/basket.html",
    "/yourinfo.html?step=payment", "/asearch.html?keyword=a+b", "/signin.html",
    "/quickview/x", "/store-locator", "/home?ref=x&page=2", "/index.html", "/HOME",
    "/bags//sale",
]
FIXTURE_PRODUCT_PATH_INDEXES = [6, 7]
FIXTURE_SOURCES = [  # (source, medium)
    ("(direct)", "(none)"), ("google", "organic"), ("google", "cpc"),
    ("youtube.com", "referral"), ("m.facebook.com", "referral"), ("bing", "organic"),
    ("t.co", "referral"), ("(not set)", "(not set)"), (None, None), ("Partners", "affiliate"),
]
FIXTURE_DEVICES = ["desktop", "mobile", "tablet", None]
FIXTURE_NULL_PATH_EVERY = 29              # of the event ids
FIXTURE_TIME_MS = 14400000                # hits of four hours share a time
FIXTURE_NULL_VISITOR = 7                  # the user whose visitor id is NULL
FIXTURE_CATEGORIES = ["Home/Apparel/Kid's/Kids-Youth/", "Home/Electronics/Audio/",
                      "(not set)", "Home/Bags/"]
# ---------------------------------------------------------------------------

# Upper bound of hits per nested row. A very long visit is stored as several
# rows with the same visit id (the flattening is row-local, so results are
# the same); no visit is ever collected into one unbounded array.
HITS_PER_ROW = 512


def _epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def _pick(values: list, index: Column) -> Column:
    """``values[index]`` for a small fixed list, as a JVM-side array lookup."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


class Largest(NamedTuple):
    """Events of the largest visit and of the largest session."""
    visit: int
    session: int


def _with_visit_keys(events: DataFrame) -> DataFrame:
    ms = epoch_millis(events, "ts")
    bucket = F.floor((ms - F.lit(FIXTURE_EPOCH_MS)) / F.lit(FIXTURE_VISIT_MS))
    return events.select("event_id", "user_id", "event_type", ms.alias("ms"), bucket.alias("b"))


def largest_groups(events: DataFrame) -> Largest:
    """Sizes of the largest visit and session of the derived source, by one
    pass that reads the visit keys only. The events of a session's visits bound
    its flat rows; visits without a visitor id are one session."""
    visits = group_sizes(_with_visit_keys(events), ["user_id", "b"])
    session = F.when(F.col("user_id") != FIXTURE_NULL_VISITOR, F.struct("user_id", "b"))
    sessions = visits.groupBy(session.alias("session")).agg(F.sum("_n").alias("n"), F.max("_n").alias("visit"))
    row = sessions.agg(F.max("visit"), F.max("n")).first()
    return Largest(row[0] or 0, row[1] or 0)


#: Largest groups of the event files that this application has read, by their
#: path and what the folder listing says of them.
_LARGEST: dict[tuple, Largest] = {}


def known_largest_groups(spark: SparkSession, path: str) -> Largest:
    """``largest_groups`` of the events saved under ``path``, counted once per
    application and state of the files."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(file)
    state = (spark.sparkContext.applicationId, path, summary.getLength(), summary.getFileCount(),
             fs.getFileStatus(file).getModificationTime())
    if state not in _LARGEST:
        _LARGEST[state] = largest_groups(spark.read.parquet(path))
    return _LARGEST[state]


def visits_from_events(events: DataFrame, rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK,
                       largest: Largest | None = None) -> DataFrame:
    """Nested visits derived from the ``events`` table (FIXTURES.md §3).

    The hit number is the position inside the visit; visits larger than
    ``rows_per_chunk`` are numbered in ordered chunks (``sequence``). If
    ``largest`` tells that there are none, they are not looked for."""
    ev = _with_visit_keys(events)
    keys, order = ["user_id", "b"], ["ms", "event_id"]
    if largest is not None and largest.visit <= rows_per_chunk:
        visits = no_chunks(keys, order)
    else:
        visits = plan_chunks(ev, keys, order, rows_per_chunk)
    ev = ordered_context(ev, visits, row_number="hit_number")

    vst = F.lit(FIXTURE_EPOCH_MS // 1000) + F.col("b") * F.lit(FIXTURE_VISIT_MS // 1000)
    purchase = F.col("event_type") == "purchase"
    even_id = F.pmod(F.col("event_id"), F.lit(2)) == 0
    path_idx = F.pmod(F.col("event_id") * 31 + F.col("user_id") * 17, F.lit(len(FIXTURE_PATHS)))
    src_idx = F.pmod(F.col("user_id") * 7 + F.col("b"), F.lit(len(FIXTURE_SOURCES)))
    source = _pick([s for s, _ in FIXTURE_SOURCES], src_idx)
    medium = _pick([m for _, m in FIXTURE_SOURCES], src_idx)
    is_cpc = medium == "cpc"

    hit = F.struct(
        F.col("hit_number").alias("hitNumber"),
        (F.col("ms") - F.pmod(F.col("ms"), F.lit(FIXTURE_TIME_MS)) - vst * 1000).alias("time"),
        F.when(F.col("event_type") == "error", "EVENT")
        .when(purchase & even_id, "TRANSACTION")
        .otherwise("PAGE").alias("type"),
        F.struct(
            F.when(purchase, F.lit("/ordercompleted.html"))
            .when(F.pmod(F.col("event_id"), F.lit(FIXTURE_NULL_PATH_EVERY)) != 0, _pick(FIXTURE_PATHS, path_idx))
            .alias("pagePath"),
            F.lit(FIXTURE_HOST).alias("hostname"),
        ).alias("page"),
        F.when(
            ~purchase & path_idx.isin(*FIXTURE_PRODUCT_PATH_INDEXES),
            F.array(F.struct(_pick(FIXTURE_CATEGORIES, F.pmod(F.col("event_id"), F.lit(4)))
                             .alias("v2ProductCategory"))),
        ).otherwise(F.array().cast("array<struct<v2ProductCategory:string>>")).alias("product"),
        F.struct(F.when(purchase & ~even_id, "6").otherwise("0").alias("action_type"))
        .alias("eCommerceAction"),
    )
    visit_attrs = [
        F.when(F.col("user_id") != FIXTURE_NULL_VISITOR, F.col("user_id").cast("string")).alias("fullVisitorId"),
        F.col("b").cast("bigint").alias("visitId"),
        vst.cast("bigint").alias("visitStartTime"),
        # formatted from a zone-less timestamp: the shard name does not
        # depend on the session time zone
        F.date_format(F.timestamp_add("SECOND", vst, _epoch_ntz()), "yyyyMMdd").alias("date"),
        F.struct(_pick(FIXTURE_DEVICES, F.pmod(F.col("user_id") + F.col("b"), F.lit(4))).alias("deviceCategory"))
        .alias("device"),
        F.struct(
            source.alias("source"),
            medium.alias("medium"),
            F.when(is_cpc, F.lit("brand")).alias("campaign"),
            F.lit(None).cast("string").alias("adContent"),
            F.when(source == "google", F.lit("(not provided)")).alias("keyword"),
            F.struct(F.when(is_cpc, F.concat(F.lit("g"), F.col("user_id").cast("string")))
                     .alias("gclid")).alias("adwordsClickInfo"),
        ).alias("trafficSource"),
    ]
    names = ["fullVisitorId", "visitId", "visitStartTime", "date", "device", "trafficSource"]
    # Visit attributes are functions of (user_id, b): computed once per output
    # row after grouping. Grouping on (user_id, b, block) reuses the window's
    # hash partitioning on (user_id, b), so no second exchange is planned.
    blocks = (
        ev.withColumn("hit_block", F.floor((F.col("hit_number") - 1) / F.lit(HITS_PER_ROW)))
        .groupBy("user_id", "b", "hit_block")
        .agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    )
    return blocks.select(*visit_attrs, "hits").select(*names, "hits")


def load_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested visits for a test-data directory (derived from ``events``)."""
    path = f"{sf_dir}/events.parquet"
    return visits_from_events(spark.read.parquet(path), configured_rows_per_chunk(spark), known_largest_groups(spark, path))


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    """Read a date-partitioned nested source with the pruned read schema."""
    return spark.read.schema(VISITS_DDL).parquet(path)


def write_visits(sessions: DataFrame, path: str, mode: str = "overwrite", with_sizes: bool = False) -> None:
    """Write nested visits as Parquet partitioned by ``date`` (one folder per
    daily shard), so date ranges prune whole folders on read. ``with_sizes``
    counts the sessions of the new shards into the manifest beside them."""
    sessions.write.mode(mode).partitionBy("date").parquet(path)
    if with_sizes:
        update_manifest(sessions.sparkSession, path, read_visits(sessions.sparkSession, path))
