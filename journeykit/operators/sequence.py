"""Skew-aware ordered windows: row number, lag / lead, first / last and
count per group, with hot groups split into ordered chunks.

A plain ``Window.partitionBy(session)`` sends a whole session to one task.
When one session (a crawler, a stuck client) holds a large share of all
rows, that task holds a large share of the job. Here:

1. ``plan_chunks`` counts rows per group (a map-side-combined aggregate; a
   manifest of sizes or a saved layout may stand in for it) and keeps the groups
   above ``rows_per_chunk`` — at most N / rows_per_chunk of them. Of those it
   samples the first two order columns, orders the sample by Spark's range
   partitioning and takes every k-th sampled position as a chunk boundary, so a
   block of one equal (or NULL) first value is cut too. Boundaries are rows until
   they are gathered per group, one for every ``rows_per_chunk`` rows. The small
   results are checkpointed into the shared checkpoint folder. Their size is
   measured before they are broadcast; beyond the limit they are joined by a
   shuffle, and rows are dealt by (group, chunk) after it.
2. ``ordered_context`` windows each (group, chunk) separately — the hot group
   is spread over many tasks — then repairs what crosses chunk edges: row
   offsets (prefix sums of chunk sizes), lag / lead at chunk edges (a window
   over the few edge rows of each chunk), group-wide first / last / count.
   Those repair tables have a few rows per chunk; the same measure decides.

Without hot groups (the usual case) the plan is the plain window: one
exchange on the group key, one sort. Results are identical either way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeykit.session import ensure_checkpoint_dir

DEFAULT_ROWS_PER_CHUNK = 1_000_000
#: Sampled rows for each chunk of a hot group.
SAMPLES_PER_CHUNK = 64
#: Steps of the binary search in an array of boundaries (below 2 ** 16 entries,
#: that is 2 ** 32 chunks a group, as boundaries are kept in two levels).
SEARCH_STEPS = [1 << i for i in range(15, -1, -1)]
MAX_BROADCAST_BYTES = 64 << 20


@dataclass
class ChunkPlan:
    keys: list[str]
    order: list[str]
    hot: DataFrame | None = None      # keys, _n, _coarse, _step (checkpointed)
    pages: DataFrame | None = None    # keys, _page, _bounds (checkpointed)
    n_hot: int = 0
    n_chunks: int = 0
    rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK
    small: bool = True                # the boundaries may be broadcast
    stored: bool = False              # the rows are of hot groups and carry their ``_chunk``

    @property
    def active(self) -> bool:
        return self.hot is not None or self.stored


def is_small(rows: DataFrame, copies: int = 1) -> bool:
    """Whether a saved table, with every row as long as its longest and
    ``copies`` times over, stays below the broadcast limit."""
    length = F.octet_length(F.to_json(F.struct(*rows.columns)))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(length)).first()
    return n * (longest or 0) * copies <= MAX_BROADCAST_BYTES


def hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, where NULL equals NULL; the keys appear once."""
    # (a hint on ``right`` passes through the projection)
    other = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys],
                         *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(other, same, how).drop(*[f"_key_{k}" for k in keys])


def ranked_in_groups(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_rank``, the position in their group from 0, and
    ``_size``, the group's rows. A group may be of any size: rows are put in
    order by range partitioning, numbered within each range, and shifted by the
    rows of the group in the ranges before."""
    ranges = (rows.repartitionByRange(*[F.asc_nulls_first(c) for c in (*keys, *order)])
              .withColumn("_range", F.spark_partition_id()).checkpoint(eager=True))
    at = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)) - 1
    sizes = ranges.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", *keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
                          F.sum("_rows").over(group).alias("_size"))
    numbered = null_safe_join(ranges.withColumn("_at", at), shifts, ["_range", *keys])
    return numbered.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_rank"), "_size")


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def plan_chunks(df: DataFrame, keys: list[str], order: list[str],
                rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK, sizes: DataFrame | None = None) -> ChunkPlan:
    """Find groups larger than ``rows_per_chunk`` and their chunk boundaries.

    One aggregate pass counts rows per group (a NULL key is a group like any
    other), unless ``sizes`` (keys, ``_n``) tells them: it holds every group
    above the limit, and its counts may be too large. Only when there are
    groups above the limit, a second pass samples their rows by a hash of key
    and order values. The same passes run whatever the input's size. The
    returned plan is reused by every window and aggregate over the same rows.
    Only rows equal in the first two order columns are sure to share a chunk."""
    plan = ChunkPlan(list(keys), list(order), rows_per_chunk=rows_per_chunk)
    ensure_checkpoint_dir(df.sparkSession)
    hot = (group_sizes(df, keys) if sizes is None else sizes).where(F.col("_n") > F.lit(rows_per_chunk))
    # The usual answer (no hot group) leaves the plain window plan.
    plan.n_hot = hot.agg(F.count(F.lit(1))).first()[0]
    if not plan.n_hot:
        return plan
    hot = hot.select(*keys, "_n").checkpoint(eager=True)
    second = F.col(order[1]) if len(order) > 1 else F.lit(None).cast("int")
    points = df.select(*keys, F.col(order[0]).alias("_t"), second.alias("_s"))
    rows = null_safe_join(points, hinted(hot, is_small(hot)), keys)
    if rows_per_chunk > SAMPLES_PER_CHUNK:
        drawn = F.pmod(F.xxhash64(*keys, "_t", "_s"), F.lit(rows_per_chunk)) < SAMPLES_PER_CHUNK
        rows = rows.where(drawn)
    ranked = ranked_in_groups(rows, keys, ["_t", "_s"])
    n_chunks = F.ceil(F.col("_n") / F.lit(rows_per_chunk))

    def chunk_at(rank: Column) -> Column:
        return F.floor(rank * n_chunks / F.col("_size"))

    cuts = ranked.where((F.col("_rank") > 0) & (chunk_at(F.col("_rank")) > chunk_at(F.col("_rank") - 1)))
    bounds = cuts.groupBy(*keys).agg(F.sort_array(F.collect_set(
        F.struct(F.col("_t").alias("t"), F.col("_s").alias("s")))).alias("_found"))
    # A row carries what it is looked up in, so boundaries are kept in pages of
    # about the square root of their number, and only a page's first one beside the group.
    size = F.size("_found")
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(size))).cast("int")
    cut = bounds.where(size > 0).select(*keys, "_found", step.alias("_step"))
    starts = F.sequence(F.lit(0), F.ceil(size / F.col("_step")).cast("int") - 1)
    plan.pages = (cut.select(*keys, "_found", "_step", F.explode(starts).alias("_page"))
                  .select(*keys, "_page", F.slice("_found", F.col("_page") * F.col("_step") + 1, F.col("_step")).alias("_bounds"))
                  .checkpoint(eager=True))
    coarse = cut.select(*keys, "_step", F.filter("_found", lambda b, i: i % F.col("_step") == 0).alias("_coarse"))
    plan.hot = null_safe_join(hot, coarse, keys, "left").checkpoint(eager=True)
    plan.n_chunks = int(plan.pages.agg(F.coalesce(F.sum(F.size("_bounds")), F.lit(0))).first()[0]) + plan.n_hot
    plan.small = is_small(plan.hot) and is_small(plan.pages)
    return plan


def session_plan(flat: DataFrame, rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK,
                 sizes: DataFrame | None = None) -> ChunkPlan:
    """Chunk plan of flat events per session, in event order."""
    return plan_chunks(flat, ["session_id"], ["trace_time", "event_seq_num"], rows_per_chunk, sizes)


def no_chunks(keys: list[str], order: list[str]) -> ChunkPlan:
    """A plan without hot groups (plain windows); no job is run."""
    return ChunkPlan(list(keys), list(order))


def stored_chunks(keys: list[str], order: list[str]) -> ChunkPlan:
    """The plan of rows that are all of hot groups and carry the ``_chunk`` they were saved with."""
    return ChunkPlan(list(keys), list(order), stored=True)


def bounds_before(bounds: Column, at: Column) -> Column:
    """How many of the ascending ``bounds`` are at or before ``at``, by binary search."""
    def further(found: Column, step: Column) -> Column:
        return F.when((found + step <= F.size(bounds)) & (F.get(bounds, found + step - 1) <= at), found + step).otherwise(found)
    return F.aggregate(F.array(*[F.lit(s) for s in SEARCH_STEPS]), F.lit(0), further)


def with_chunks(df: DataFrame, plan: ChunkPlan) -> DataFrame:
    """Add ``_chunk`` (0 outside hot groups) and ``_hot``.

    Chunks follow the first two order columns (NULL first), so chunk order is
    row order."""
    if plan.stored:
        return df.select("*", F.lit(True).alias("_hot"))
    if not plan.active:
        return df.select("*", F.lit(0).alias("_chunk"), F.lit(False).alias("_hot"))
    keys, names = plan.keys, df.columns
    second = F.col(plan.order[1]) if len(plan.order) > 1 else F.lit(None).cast("int")
    at = F.struct(F.col(plan.order[0]).alias("t"), second.alias("s"))
    side = hinted(plan.hot.select(*keys, F.lit(True).alias("_hot"), "_coarse", "_step"), plan.small)
    page = F.greatest(bounds_before(F.col("_coarse"), at), F.lit(1)) - 1
    paged = null_safe_join(df, side, keys, "left").select(
        *names, F.coalesce("_hot", F.lit(False)).alias("_hot"), F.when(F.col("_coarse").isNotNull(), page).alias("_page"), "_step")
    found = null_safe_join(paged, hinted(plan.pages, plan.small), [*keys, "_page"], "left")
    chunk = F.col("_page") * F.col("_step") + bounds_before(F.col("_bounds"), at)
    out = found.select(*names, F.coalesce(F.when(F.col("_bounds").isNotNull(), chunk), F.lit(0)).alias("_chunk"), "_hot")
    # The shuffled join leaves a hot group in one place: deal its chunks out.
    return out if plan.small else out.repartition(*plan.keys, "_hot", "_chunk")


def ordered_context(df: DataFrame, plan: ChunkPlan, *, row_number: str | None = None,
                    lags: list[tuple] = (), leads: list[tuple] = (),
                    firsts: list[tuple] = (), lasts: list[tuple] = (),
                    counts: list[tuple] = (), keep_chunk: bool = False) -> DataFrame:
    """Add group-wide ordered window values to every row of ``df``.

    ``lags`` / ``leads``: (name, column, offset, default) — default only when
    no such row exists; ``firsts`` / ``lasts``: (name, column), NULLs kept;
    ``counts``: (name, column), non-NULL values in the whole group;
    ``row_number``: name of the 1-based position (BIGINT). A new name equal
    to an input column replaces it.
    """
    keys, order = plan.keys, plan.order
    unb = Window.unboundedPreceding, Window.unboundedFollowing
    new_names = ([row_number] if row_number else []) + [s[0] for s in (*lags, *leads, *firsts, *lasts, *counts)]
    kept = [c for c in df.columns if c not in new_names and c != "_chunk"]

    def w_(name: str) -> str:
        return f"_w_{name}"

    def window_cols(part: list[str]) -> list[Column]:
        w = Window.partitionBy(*part).orderBy(*order)
        whole = w.rowsBetween(*unb)
        grp = Window.partitionBy(*part)
        cols = []
        if row_number:
            cols.append(F.row_number().over(w).cast("bigint").alias(w_(row_number)))
        cols += [F.lag(c, o, d).over(w).alias(w_(n)) for n, c, o, d in lags]
        cols += [F.lead(c, o, d).over(w).alias(w_(n)) for n, c, o, d in leads]
        cols += [F.first(c).over(whole).alias(w_(n)) for n, c in firsts]
        cols += [F.last(c).over(whole).alias(w_(n)) for n, c in lasts]
        cols += [F.count(c).over(grp).alias(w_(n)) for n, c in counts]
        return cols

    extra = [F.col("_chunk"), F.col("_hot")] if keep_chunk else []
    if not plan.active:
        windowed = df.select("*", *window_cols(keys))
        if keep_chunk:
            windowed = windowed.select("*", F.lit(0).alias("_chunk"), F.lit(False).alias("_hot"))
        return windowed.select(*kept, *[F.col(w_(n)).alias(n) for n in new_names], *extra)

    ck = [*keys, "_chunk"]
    # ``_hot`` is constant per group, so adding it to the partition spec
    # changes nothing but lets a filter on it move below the exchange: the
    # edge tables below shuffle only the hot groups' rows.
    part = [*keys, "_hot", "_chunk"]
    chunked = with_chunks(df, plan)
    wl = Window.partitionBy(*part).orderBy(*order)
    local = chunked.select(
        "*",
        F.row_number().over(wl).alias("_lrn"),
        F.count(F.lit(1)).over(Window.partitionBy(*part)).alias("_lcnt"),
        *window_cols(part),
    )

    # Edge rows: the first and last `depth` rows of every hot chunk. Each row
    # needing repair and every row it may reach are among them, in order.
    depth = max([1] + [o for _, _, o, _ in lags] + [o for _, _, o, _ in leads])
    sources = list(dict.fromkeys([c for _, c, _, _ in lags] + [c for _, c, _, _ in leads]
                                 + [c for _, c in firsts] + [c for _, c in lasts]))
    at_edge = (F.col("_lrn") <= depth) | (F.col("_lrn") > F.col("_lcnt") - depth)
    # At most 2 * depth rows per hot chunk: computed once and checkpointed
    # (its three uses below then read the small saved copy).
    edge = local.filter(F.col("_hot") & at_edge).select(
        *part, "_lrn", "_lcnt", *[c for c in order if c not in sources and c not in ck], *sources,
        *[w_(n) for n, _ in counts]).checkpoint(eager=True)
    # the repair rows hold a value of the edge rows for each lag, lead, first and last
    small = is_small(edge, 1 + len(lags) + len(leads) + len(firsts) + len(lasts))
    wg = Window.partitionBy(*keys).orderBy(*order)
    fix_names = [f"_fix_{n}" for n, _, _, _ in (*lags, *leads)]
    edge_fix = edge.select(
        *part, "_lrn",
        *[F.lag(c, o, d).over(wg).alias(f"_fix_{n}") for n, c, o, d in lags],
        *[F.lead(c, o, d).over(wg).alias(f"_fix_{n}") for n, c, o, d in leads],
    )
    per_chunk = edge.groupBy(*part).agg(
        F.max("_lcnt").alias("_csize"), *[F.max(w_(n)).alias(f"_c_{n}") for n, _ in counts])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole_group = Window.partitionBy(*keys)
    repair = per_chunk.select(
        *part,
        F.coalesce(F.sum("_csize").over(before), F.lit(0)).alias("_offset"),
        *[F.sum(f"_c_{n}").over(whole_group).alias(f"_tot_{n}") for n, _ in counts],
    )
    if fix_names:
        # per chunk, its (at most 2 * depth) edge repairs as a map position → values
        edge_maps = edge_fix.groupBy(*part).agg(F.map_from_entries(F.collect_list(
            F.struct("_lrn", F.struct(*fix_names)))).alias("_fixes"))
        repair = null_safe_join(repair, hinted(edge_maps, small), part, "left")
    if firsts or lasts:
        ordering = F.struct(*order)
        group_ends = edge.groupBy(*keys).agg(
            *[F.min_by(c, ordering).alias(f"_first_{n}") for n, c in firsts],
            *[F.max_by(c, ordering).alias(f"_last_{n}") for n, c in lasts],
        )
        repair = null_safe_join(repair, hinted(group_ends, small), keys, "left")

    # One repair row per hot chunk, joined on the main data's own partitioning
    # (group, hot, chunk) — ``_hot`` comes from the saved edge rows, so it is a
    # join key, not a constant: broadcast when the measured size allows,
    # otherwise only the small side moves.
    joined = null_safe_join(local, hinted(repair, small), part, "left")
    hot, lrn = F.col("_hot"), F.col("_lrn")
    for name in fix_names:
        joined = joined.withColumn(name, F.try_element_at(F.col("_fixes"), lrn)[name])

    def pick(n: str, fixed: str, cond: Column) -> Column:
        return F.when(cond, F.col(fixed)).otherwise(F.col(w_(n))).alias(n)

    result = []
    if row_number:
        result.append((lrn + F.coalesce(F.col("_offset"), F.lit(0))).cast("bigint").alias(row_number))
    result += [pick(n, f"_fix_{n}", hot & (lrn <= o)) for n, _, o, _ in lags]
    result += [pick(n, f"_fix_{n}", hot & (lrn > F.col("_lcnt") - o)) for n, _, o, _ in leads]
    result += [pick(n, f"_first_{n}", hot) for n, _ in firsts]
    result += [pick(n, f"_last_{n}", hot) for n, _ in lasts]
    result += [pick(n, f"_tot_{n}", hot) for n, _ in counts]
    return joined.select(*kept, *result, *extra)
