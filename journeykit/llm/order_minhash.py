"""Document fingerprints by order MinHash, in DataFrame functions only.

A text's k-mers (runs of ``kmer_words`` word pieces) are numbered by
occurrence, so a k-mer's second occurrence differs from its first. Of the
numbered k-mers the ones with the smallest hashes are selected and put back in
text order; every ``tuple_size`` that follow each other are hashed together.
The tuples change with what a text says and with the order in which it says
it, so the share of equal tuples follows edit distance.

Everything is array work within a row: no shuffle, whatever the text's length.
"""

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeykit.llm.storage import saved

#: A run of up to 16 characters without white space, whole; of a longer run every 16 characters that follow each other.
PIECE = (r"(?=((?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D]{1,16}+(?![^\\x20\\x09-\\x0D])|[^\\x20\\x09-\\x0D]{16}))"
         r"(?:\\1(?![^\\x20\\x09-\\x0D])|[^\\x20\\x09-\\x0D])")

#: A selected k-mer is one long: 39 bits of hash beside 24 bits of position.
POSITION_BITS, HASH_BITS = 24, 39
POSITION_MASK, HASH_MASK = (1 << POSITION_BITS) - 1, (1 << HASH_BITS) - 1


def add_fingerprint(df: DataFrame, text: str, out: str, kmer_words: int = 3, selected: int = 65,
                    tuple_size: int = 2) -> DataFrame:
    """``df`` with ``out``: the array of tuple hashes (longs below 2^32) of the
    text column ``text``.

    Word pieces are runs of up to 16 characters without white space; a longer
    run has a piece of 16 at each of its characters that has so many left, so an
    edit changes only the pieces that it lies in. A text
    with fewer pieces than a k-mer is one k-mer, fewer selected k-mers than a
    tuple are one tuple, no piece gives an empty array; null counts as empty.
    Positions past 2^24 pieces count as that position.
    """
    t = f"_{out}"
    keep = [F.col(f"`{c}`") for c in df.columns]
    k, s, z = kmer_words, selected, tuple_size
    pieces = ", ".join(f"get(`{t}w`, i + {j})" for j in range(k))
    parts = ", ".join(f"get(`{t}o`, i + {j}) & {HASH_MASK}L" for j in range(z))

    def step(df: DataFrame, name: str, sql: str, *carried: str) -> DataFrame:
        return df.select(*keep, *[f"`{t}{c}`" for c in carried], F.expr(sql).alias(t + name))

    # A column that a lambda reads is read outside it as well: it is then
    # computed once a row, not once for each element.
    df = step(df, "w", f"regexp_extract_all(coalesce(`{text}`, ''), '{PIECE}', 1)")
    df = step(df, "p", f"""
        CASE WHEN size(`{t}w`) >= {k} THEN sort_array(transform(sequence(0, size(`{t}w`) - {k}),
               i -> shiftleft(xxhash64({pieces}) & {HASH_MASK}L, {POSITION_BITS}) | least(i, {POSITION_MASK})))
             WHEN size(`{t}w`) > 0 THEN array(shiftleft(xxhash64(array_join(`{t}w`, ' ')) & {HASH_MASK}L, {POSITION_BITS}))
             ELSE array() END""")
    # Where a run of equal k-mers begins in the sorted array.
    df = step(df, "b", f"""
        CASE WHEN size(`{t}p`) = 0 THEN array() ELSE filter(sequence(0, size(`{t}p`) - 1), i -> i = 0
             OR shiftright(get(`{t}p`, i), {POSITION_BITS}) != shiftright(get(`{t}p`, i - 1), {POSITION_BITS})) END""", "p")
    df = step(df, "n", f"""
        CASE WHEN size(`{t}p`) = 0 THEN array() ELSE flatten(transform(`{t}b`, (at, r) ->
             sequence(0, coalesce(get(`{t}b`, r + 1), size(`{t}p`)) - at - 1))) END""", "p")
    df = step(df, "o", f"""
        CASE WHEN size(`{t}n`) = 0 THEN array() ELSE sort_array(transform(slice(sort_array(transform(`{t}p`, (v, i) -> shiftleft(xxhash64(
               shiftright(v, {POSITION_BITS}), get(`{t}n`, i)) & {HASH_MASK}L, {POSITION_BITS}) | (v & {POSITION_MASK}))),
             1, {s}), v -> shiftleft(v & {POSITION_MASK}, {HASH_BITS}) | shiftright(v, {POSITION_BITS}))) END""", "n")
    return df.select(*keep, F.expr(f"""
        CASE WHEN size(`{t}o`) = 0 THEN array() WHEN size(`{t}o`) < {z}
             THEN array(xxhash64(array_join(transform(`{t}o`, v -> v & {HASH_MASK}L), ' ')) & 4294967295L)
             ELSE transform(sequence(0, size(`{t}o`) - {z}), i -> xxhash64({parts}) & 4294967295L) END""")
        .cast("array<bigint>").alias(out))


def fingerprint_text(tuples: str | Column) -> Column:
    """A fingerprint as text: 8 hex digits a tuple."""
    return F.array_join(F.transform(tuples, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of equal tuples (0 to 1): those of both by those of the larger; 1 for two empty ones."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def with_next(df: DataFrame, id_col: str, columns: dict[str, str], tie: list[str], buckets: int,
              spread: str | None = None) -> DataFrame:
    """``df`` with, for each ``name: new name`` of ``columns``, the value in the
    next row by descending id (after the last row: the first).

    Rows are dealt by id into ranges; a range is ordered by one task. The first
    row of a range is also sent to the range before, so one shuffle serves.
    Null ids come last; rows of equal ids are ordered by ``spread``, a hash of
    the row as a long, then by ``tie``; rows equal in these are alike to the
    result. With ``spread``, the rows without an id, and those of an id that
    fills more than a range, are dealt by it into ranges of their own; without
    it they stay in one. The driver gets the boundaries; each range's first key
    is joined (at most three times ``buckets`` rows).
    """
    id_ = F.col(id_col)
    found = df.agg(F.percentile_approx(id_, [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets)).first()[0]
    fills = Counter(found or [])
    cuts = sorted(fills)
    # Of n boundaries every sqrt(n)-th is tried first, then those after the last that fits.
    step = max(1, math.isqrt(len(cuts)))
    coarse, fine = (F.array(*[F.lit(c) for c in x]).cast("array<bigint>") for x in (cuts[::step], cuts))
    block = F.size(F.filter(coarse, lambda c: c <= id_))
    rest = F.size(F.filter(F.slice(fine, (F.greatest(block, F.lit(1)) - 1) * step + 1, F.lit(step)), lambda c: c <= id_))
    at = F.when(id_.isNull(), F.lit(-1)).otherwise((F.greatest(block, F.lit(1)) - 1) * step + rest)
    bucket, first_key, order = at * (buckets + 2), [F.bitwise_not(id_).alias("id")], [id_.desc_nulls_last()]
    if spread:
        hash_ = F.col(spread)
        hot = [x for c, n in fills.items() if n > 1 for x in (F.lit(c).cast("bigint"), F.lit(n))]
        ranges = F.when(id_.isNull(), F.lit(buckets)).when(id_.isNotNull(), F.element_at(F.create_map(*hot), id_) if hot else None)
        # Such an id is the smallest of its range: its own ranges come after the others.
        own = F.least(F.floor((hash_ / F.lit(2.0 ** 64) + 0.5) * ranges), ranges - 1) + 1
        bucket, first_key = bucket - F.coalesce(own, F.lit(0)), [*first_key, hash_.alias("hash")]
        order.append(hash_)
    dealt = df.withColumn("__bucket", bucket.cast("bigint"))
    first = F.struct(*first_key)
    # Beside each range its first key and the range read before it, going down and round.
    tops = saved(dealt.groupBy("__bucket").agg(F.min(first).alias("__first")), "range-keys")
    before = F.lag("__bucket").over(Window.orderBy(F.col("__bucket").desc()))
    plan = tops.withColumn("__before", F.coalesce(before, F.min("__bucket").over(Window.partitionBy())))
    here = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("__before").alias("b"), F.lit(1).alias("guest"))
    sent = dealt.join(F.broadcast(plan), "__bucket").withColumn("__at", F.explode(
        F.when(first.eqNullSafe(F.col("__first")), F.array(here, guest)).otherwise(F.array(here))))
    w = Window.partitionBy("__at.b").orderBy(F.col("__at.guest"), *order, *[F.col(c) for c in tie])
    return (sent.select("*", *[F.lead(c).over(w).alias(n) for c, n in columns.items()])
            .where("__at.guest = 0").drop("__at", "__bucket", "__before", "__first"))
