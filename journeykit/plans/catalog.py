"""Query catalog: every operator and analysis under one key.

``JourneyData`` wires the layers lazily — nested visits → flat events (C1) →
session facts (C3) / navigation step (C4) → parameters (C5), sequencing
facts (C6), enrichment (C7), flags (C8). Only layers that need sessions in
order ask which sessions are too large for one task. A saved layout or the
manifest beside the shards tells; else one aggregate job counts. Everything
else runs when a result is collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from journeykit.functions.rules import page_template
from journeykit.operators.enrich import enriched_events, events_with_facts, session_source_flags
from journeykit.operators.flatten import preprocess_hits
from journeykit.operators.incremental import facts_from_states, read_states, save_states
from journeykit.operators.navigation import NAVIGATION_COLUMNS, navigation_context
from journeykit.operators.sequence import ChunkPlan, no_chunks, session_plan, stored_chunks
from journeykit.operators.sequence_facts import sequence_session_facts
from journeykit.operators.sessions import first_touch, session_facts
from journeykit.operators.transitions import page_transitions
from journeykit.operators.url_params import URL_PARAM_COLUMNS, url_params
from journeykit.plans import analyses as A
from journeykit.session import ensure_checkpoint_dir, rows_per_chunk
from journeykit.sources.manifest import session_sizes
from journeykit.sources.tables import hot_table, read_table, write_split_by_session
from journeykit.sources.visits import known_largest_groups, load_visits, read_visits, write_visits

SESSION_FACT_COLUMNS = [
    "session_id", "journey_path", "journey_steps", "journey_duration_seconds",
    "primary_device_type", "entry_page_template", "traffic_source_first",
    "traffic_medium_first", "traffic_campaign_first", "saw_product_detail",
    "has_conversion",
]

#: First and last daily shard that ``preprocess_hits_date_range`` reads.
DATE_RANGE = ("20240103", "20240112")

SESSION = ["session_id"]
EVENTS_IN_ORDER = ["trace_time", "event_seq_num"]


@dataclass
class JourneyData:
    """Lazily built layers over one nested visit source."""

    sessions: DataFrame | None
    date_from: str | None = None
    date_to: str | None = None
    rows_per_chunk: int | None = None
    sizes: Callable[[int], DataFrame | None] | None = None
    _cache: dict = field(default_factory=dict, repr=False)

    @classmethod
    def from_flat(cls, flat: DataFrame, rows_per_chunk: int | None = None) -> "JourneyData":
        """Start from flat events, e.g. the saved table bucketed by
        ``session_id`` (``sources.tables``): per-session steps then read the
        buckets without an exchange."""
        data = cls(None, rows_per_chunk=rows_per_chunk)
        data._cache["flat"] = flat
        return data

    @classmethod
    def from_saved(cls, flat: DataFrame, navigation: DataFrame) -> "JourneyData":
        """Start from saved flat events and the navigation step saved from
        them (``nav_chunked``, chunk columns included): the session windows
        are then computed once for all sequencing keys."""
        data = cls.from_flat(flat)
        data._cache["nav_chunked"] = navigation
        return data

    @classmethod
    def from_visits(cls, spark: SparkSession, path: str, date_from: str | None = None,
                    date_to: str | None = None) -> "JourneyData":
        """Start from the date-sharded nested visit files (pruned read schema,
        date range as a partition filter). Session sizes come from the manifest
        beside the shards, if it is there and up to date. For repeated analyses,
        flatten once, save with ``sources.write_split_by_session`` and use
        ``from_split``."""
        return cls(read_visits(spark, path), date_from=date_from, date_to=date_to,
                   sizes=lambda limit: session_sizes(spark, path, date_from, date_to, limit))

    @classmethod
    def from_split(cls, spark: SparkSession, table: str) -> "JourneyData":
        """Start from the two tables of ``sources.write_split_by_session``:
        no session of the first is too large for one task, and the rows of the
        second carry their chunks, so no sizes are counted."""
        plain = cls.from_flat(read_table(spark, table))
        plain._cache["plan"] = no_chunks(SESSION, EVENTS_IN_ORDER)
        hot = cls.from_flat(read_table(spark, hot_table(table)))
        hot._cache["plan"] = stored_chunks(SESSION, EVENTS_IN_ORDER)
        return SplitJourneyData(None, plain=plain, hot=hot)

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, date_from: str | None = None,
                      date_to: str | None = None) -> "JourneyData":
        data = cls(load_visits(spark, sf_dir), date_from, date_to)
        if known_largest_groups(spark, f"{sf_dir}/events.parquet").session <= rows_per_chunk(spark):
            data._cache["plan"] = no_chunks(SESSION, EVENTS_IN_ORDER)
        return data

    def where_session(self, condition: Column) -> "JourneyData":
        """The same layers over the flat events whose ``session_id`` satisfies ``condition``."""
        data = JourneyData.from_flat(self.flat.where(condition), self.rows_per_chunk)
        if not self.plan.active:
            data._cache["plan"] = self.plan
        return data

    def _get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def flat(self) -> DataFrame:
        return self._get("flat", lambda: preprocess_hits(self.sessions, self.date_from, self.date_to))

    def flat_where(self, hit_filter) -> DataFrame:
        """Flat events of the hits satisfying ``hit_filter`` only (filtered
        before ``explode``); falls back to the shared flat events when the
        layers start from a flat table."""
        if self.sessions is None:
            return self.flat
        return preprocess_hits(self.sessions, self.date_from, self.date_to, hit_filter)

    @property
    def plan(self) -> ChunkPlan:
        """Hot sessions and their chunk boundaries, found once per data set
        (see the module's docstring; results are checkpointed)."""
        def build() -> ChunkPlan:
            limit = self.rows_per_chunk or rows_per_chunk(self.flat.sparkSession)
            return session_plan(self.flat, limit, self.sizes(limit) if self.sizes else None)
        return self._get("plan", build)

    @property
    def facts(self) -> DataFrame:
        """C3 plus ``journey_duration_ms`` (used for exact mean durations)."""
        return self._get("facts", lambda: session_facts(self.flat, with_duration_ms=True, plan=self.plan))

    @property
    def facts_without_path(self) -> DataFrame:
        """C3 without ``journey_path``: its other facts merge map-side, so no sizes are asked for."""
        return self._get("facts_without_path", lambda: session_facts(self.flat, with_duration_ms=True, with_path=False))

    @property
    def first_touch(self) -> DataFrame:
        return self._get("first_touch", lambda: first_touch(self.flat, self.plan))

    @property
    def nav_chunked(self) -> DataFrame:
        """C4 with the internal chunk columns when hot sessions exist."""
        return self._get("nav_chunked", lambda: navigation_context(
            self.flat, self.plan, keep_chunk=self.plan.active, keep_hit=True))

    @property
    def navigation(self) -> DataFrame:
        return self._get("navigation", lambda: self.nav_chunked.select(*NAVIGATION_COLUMNS))

    @property
    def params(self) -> DataFrame:
        return self._get("params", lambda: url_params(self.nav_chunked).select(*URL_PARAM_COLUMNS))

    @property
    def seq_facts(self) -> DataFrame:
        return self._get("seq_facts", lambda: sequence_session_facts(self.nav_chunked))

    @property
    def events_with_facts(self) -> DataFrame:
        """Events before the parameters are taken apart, with the facts of their session."""
        return self._get("events_with_facts", lambda: events_with_facts(self.nav_chunked))

    @property
    def enriched(self) -> DataFrame:
        return self._get("enriched", lambda: enriched_events(self.nav_chunked))

    @property
    def flags(self) -> DataFrame:
        return self._get("flags", lambda: session_source_flags(self.nav_chunked))


@dataclass
class SplitJourneyData(JourneyData):
    """The layers of two sets of sessions, each worked out by itself: every
    layer is per event or per session, so together they are those of all."""

    plain: JourneyData | None = None
    hot: JourneyData | None = None

    def _get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._cache:
            plain, hot = getattr(self.plain, name), getattr(self.hot, name)
            self._cache[name] = plain.unionByName(hot.select(*plain.columns))
        return self._cache[name]

    @property
    def flat(self) -> DataFrame:
        return self._get("flat", lambda: None)

    def where_session(self, condition: Column) -> JourneyData:
        return SplitJourneyData(None, plain=self.plain.where_session(condition), hot=_stored(self.hot.flat.where(condition)))


def _stored(rows: DataFrame) -> JourneyData:
    data = JourneyData.from_flat(rows)
    data._cache["plan"] = stored_chunks(SESSION, EVENTS_IN_ORDER)
    return data


def sample_session(data: JourneyData) -> DataFrame:
    """Q27: the session is found first, so that its rows alone are windowed.

    A session without a missing URL keeps its first event, so the smallest such
    id bounds the one looked for: of the sessions up to it, which have a missing
    URL but for the last, the smallest with a row is taken."""
    bound = A.smallest_session_with_urls(data.flat).first()[0]
    few = data if bound is None else data.where_session(F.col("session_id") <= bound)
    chosen = few.navigation.agg(F.min("session_id")).first()[0]
    return A.session_rows(data.where_session(F.col("session_id") == F.lit(chosen)).params)


def _saved_shards(spark: SparkSession, sf_dir: str) -> str:
    """The nested visits as date shards with their manifest, in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/visits-{uuid.uuid4().hex}"
    write_visits(load_visits(spark, sf_dir), path, with_sizes=True)
    return path


def from_saved_shards(spark: SparkSession, sf_dir: str, *dates: str) -> JourneyData:
    """Write the visits as date shards, and start from these files."""
    return JourneyData.from_visits(spark, _saved_shards(spark, sf_dir), *dates)


def from_saved_table(spark: SparkSession, sf_dir: str) -> JourneyData:
    """Write the flat events as the two tables by session, and start from these."""
    data = JourneyData.from_testdata(spark, sf_dir)
    name = f"flat_events_{uuid.uuid4().hex}"
    write_split_by_session(data.flat, name, data.plan, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")),
                           path=f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    return JourneyData.from_split(spark, name)


def incremental_session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 from states: those of the days up to a day are saved, then those of the days after it, and both merged."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/session-states-{uuid.uuid4().hex}"
    visits = load_visits(spark, sf_dir)
    for shard, first, last in (("first", None, DATE_RANGE[1]), ("second", DATE_RANGE[1] + "~", None)):
        save_states(preprocess_hits(visits, first, last), path, shard)
    return facts_from_states(read_states(spark, path))


QUERY_BUILDERS: dict[str, Callable[[JourneyData], DataFrame]] = {
    # composite operators
    "preprocess_hits": lambda d: d.flat,
    "first_touch": lambda d: d.first_touch,
    "session_facts": lambda d: d.facts.select(*SESSION_FACT_COLUMNS),
    "navigation_context": lambda d: d.navigation,
    "url_params": lambda d: d.params,
    "sequence_session_facts": lambda d: d.seq_facts,
    "enriched_events": lambda d: d.enriched,
    # analyses on flat events and session facts
    "events_by_page_template": lambda d: A.events_by_page_template(d.flat),
    "source_medium_single_product": lambda d: A.source_medium_single_product(d.facts_without_path),
    "traffic_medium_frequency": lambda d: A.traffic_medium_frequency(d.facts_without_path),
    "traffic_source_frequency": lambda d: A.traffic_source_frequency(d.facts_without_path),
    "journey_frequency_by_device": lambda d: A.journey_frequency_by_device(d.facts),
    "sessions_by_source_type": lambda d: A.sessions_by_source_type(d.flat),
    "bounce_non_google": lambda d: A.bounce_non_google(d.facts_without_path),
    "conversion_totals": lambda d: A.conversion_totals(d.facts_without_path),
    "landing_page_frequency": lambda d: A.landing_page_frequency(
        d.flat_where(lambda h: h["hitNumber"] == 1)),
    "homepage_entry_outcomes": lambda d: A.homepage_entry_outcomes(d.facts_without_path),
    "category_entry_outcomes": lambda d: A.category_entry_outcomes(d.facts_without_path),
    "product_impressions_by_category": lambda d: A.product_impressions_by_category(
        d.flat_where(lambda h: page_template(h["page"]["pagePath"]) == "ProductDetail")),
    "medium_performance": lambda d: A.medium_performance(d.facts_without_path),
    "channel_group_performance": lambda d: A.channel_group_performance(d.facts_without_path),
    # analyses on the sequencing chain
    "bigram_transitions": lambda d: page_transitions(d.navigation, 2),
    "trigram_transitions": lambda d: page_transitions(d.navigation, 3),
    "enriched_event_count": lambda d: A.enriched_event_count(d.params),
    "session_google_flags": lambda d: d.flags,
    "google_traffic_totals": lambda d: A.google_traffic_totals(d.flags),
    "journey_fingerprint_frequency": lambda d: A.journey_fingerprint_frequency(d.seq_facts),
    "entry_source_medium": lambda d: A.entry_source_medium(d.seq_facts),
    "category_frequency": lambda d: A.category_frequency(d.params),
    "single_product_journeys_by_source": lambda d: A.single_product_journeys_by_source(d.seq_facts),
    "traffic_by_source": lambda d: A.traffic_by_source(d.events_with_facts),
    "entry_traffic_by_source": lambda d: A.entry_traffic_by_source(d.events_with_facts),
    "sessions_by_journey": lambda d: A.sessions_by_journey(d.seq_facts),
    "sample_session": sample_session,
}


def query_catalog() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """key → callable(spark, sf_dir) → DataFrame, reading the test tables."""
    def make(builder):
        return lambda spark, sf_dir: builder(JourneyData.from_testdata(spark, sf_dir))
    catalog = {key: make(builder) for key, builder in QUERY_BUILDERS.items()}
    catalog["preprocess_hits_date_range"] = lambda spark, sf_dir: JourneyData.from_testdata(
        spark, sf_dir, *DATE_RANGE).flat
    # the same layers from saved date shards and from the saved tables
    catalog["preprocess_hits_from_shards"] = lambda spark, sf_dir: from_saved_shards(spark, sf_dir, *DATE_RANGE).flat
    catalog["session_facts_from_shards"] = lambda spark, sf_dir: QUERY_BUILDERS["session_facts"](
        from_saved_shards(spark, sf_dir))
    catalog["session_facts_incremental"] = incremental_session_facts
    for key in ("session_facts", "navigation_context", "enriched_events"):
        catalog[f"{key}_from_table"] = lambda spark, sf_dir, build=QUERY_BUILDERS[key]: build(from_saved_table(spark, sf_dir))
    return catalog
