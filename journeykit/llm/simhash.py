"""SimHash near-dedup with pigeonring filtering.

A fingerprint's 64 bits are cut into ``segments`` consecutive segments on a
ring. If two fingerprints differ in at most t bits, then some chain of segments
starts where, for every length l, the first l segments together differ in at
most l * t / segments bits (the pigeonring principle). While that budget is
below one the segments are equal, so the first ones of a chain are an exact
join key, one for each start on the ring; the rest of the chain prunes a
candidate before the full Hamming check.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from journeykit.llm.components import connected_components
from journeykit.llm.embedding_dedup import star_forest
from journeykit.llm.storage import saved

FULL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_of(text: bytes | None, shingle_words: int) -> int:
    """SimHash of one UTF-8 text as a signed long; 0 for null or no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, total, ones = xxhash.xxh64_digest, max(1, len(words) - shingle_words + 1), np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        block = words[at:at + (1 << 16) + shingle_words - 1]
        joined = b" ".join(block)
        ends = np.cumsum([len(w) + 1 for w in block]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        stops = ends.tolist()[min(shingle_words, len(block)) - 1:]
        hashes = b"".join([digest(joined[s:e], 42) for s, e in zip(starts, stops)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big", signed=True)


def simhash(text: Column, shingle_words: int = 3) -> Column:
    """Fingerprint column (signed long) of a text column."""
    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, shingle_words) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())
    return arrow_udf(batch, "long")(text)


def chains(segments: int, max_bits: int) -> list[list[tuple[int, int]]]:
    """For every start on the ring: (mask, most differing bits) of the chain's
    first l segments, l from 1 to all."""
    cut = [round(i * 64 / segments) for i in range(segments + 1)]
    masks = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(segments)]
    out = []
    for start in range(segments):
        mask, chain = 0, []
        for length in range(1, segments + 1):
            mask |= masks[(start + length - 1) % segments]
            chain.append((mask, length * max_bits // segments))
        out.append(chain)
    return out


def bucket_forest(key: tuple, rows: pa.Table, rings: list, max_bits: int) -> pa.Table:
    """Spanning forest of the links between two tiles of one large bucket."""
    ring, lo, hi = key[0].as_py(), key[2].as_py(), key[3].as_py()
    fps, tile = rows["fp"].to_numpy(), rows["tile"].to_numpy()
    fps = np.concatenate([fps[tile == lo], fps[tile == hi]]) if lo != hi else fps
    split, bits = (int((tile == lo).sum()) if lo != hi else 0), fps.view(np.uint64)
    left, found = (split if lo != hi else len(fps)), [(np.empty(0, int), np.empty(0, int))]
    for at in range(0, left, 256):
        differ = bits[at:min(at + 256, left), None] ^ bits[None, split:]
        near = np.ones(differ.shape, bool)
        for mask, most in rings[ring]:
            near &= np.bitwise_count(differ & np.uint64(mask)) <= most
        near &= np.bitwise_count(differ) <= max_bits
        i, j = np.nonzero(near)
        found.append((i + at, j + split))
    root = star_forest(len(fps), np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
    moved = np.nonzero(root != np.arange(len(fps)))[0]
    return pa.table({"a": pa.array(fps[moved], pa.int64()), "b": pa.array(fps[root[moved]], pa.int64())})


def fingerprint_links(fingerprints: DataFrame, max_bits: int, segments: int, bucket_rows: int,
                      tile_rows: int) -> DataFrame:
    """Links ``(a, b)`` that connect what is within ``max_bits`` among distinct
    fingerprints (column ``fp``).

    Buckets of up to ``bucket_rows`` fingerprints are joined; a larger one is
    cut into tiles, and pairs of tiles are compared in full by bounded tasks
    that return a spanning forest of their links. Both ways are exact.
    """
    rings = chains(segments, max_bits)
    exact = [[mask for mask, most in chain if most == 0][-1] for chain in rings]
    keyed = fingerprints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key"))
        for i, mask in enumerate(exact)])).alias("k")).select("fp", "k.ring", "k.key")
    sizes = keyed.groupBy("ring", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    busy = saved(keyed.join(sizes, ["ring", "key"]), "simhash-buckets")

    cold = busy.where(F.col("n") <= bucket_rows)
    x, y = cold.alias("x"), cold.alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    viable = F.lit(False)
    for i, chain in enumerate(rings):
        within = F.col("x.ring") == i
        for mask, most in chain:
            if 0 < most and mask != FULL:
                within &= F.bit_count(differ.bitwiseAND(F.lit(signed(mask)))) <= most
        viable |= within
    pairs = (x.join(y, (F.col("x.ring") == F.col("y.ring")) & (F.col("x.key") == F.col("y.key"))
                    & (F.col("x.fp") < F.col("y.fp")) & viable & (F.bit_count(differ) <= max_bits))
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))

    tiles = F.ceil(F.col("n") / F.lit(tile_rows)).cast("int")
    hot = (busy.where(F.col("n") > bucket_rows).withColumn("tile", F.pmod(F.xxhash64("fp"), tiles).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
           .select("ring", "key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"),
                   "tile", "fp"))
    forests = hot.groupBy("ring", "key", "lo", "hi").applyInArrow(
        lambda key, table: bucket_forest(key, table, rings, max_bits), "a long, b long")
    return pairs.unionByName(forests)


def fingerprint_components(fingerprints: DataFrame, max_bits: int = 2, segments: int = 5, bucket_rows: int = 2048,
                           tile_rows: int = 2048) -> DataFrame:
    """``(fp, part)``: every distinct fingerprint of column ``fp`` with the
    smallest fingerprint that it reaches over links of ``max_bits`` or fewer
    differing bits. ``segments`` must exceed ``max_bits``."""
    if segments <= max_bits:
        raise ValueError("segments must exceed max_bits")
    distinct = saved(fingerprints.select("fp").distinct(), "fingerprints")
    parts = connected_components(fingerprint_links(distinct, max_bits, segments, bucket_rows, tile_rows))
    return (distinct.join(parts.withColumnRenamed("id", "fp"), "fp", "left")
            .select("fp", F.coalesce("component", "fp").alias("part")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                       max_bits: int = 2, **search) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id``.

    Texts are lower-cased in A-Z, cut into words and shingles; a text shorter
    than a shingle is one shingle, a null, empty or blank text has fingerprint
    zero and links like any other. Rows that repeat (equal texts, whatever
    their ids) share a fingerprint and so a component. A null id never names a
    component that holds other ids. Long texts are hashed in blocks of bounded
    size. Other columns are not read; an empty table gives an empty result.
    """
    prints = saved(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), shingle_words).alias("fp")),
                   "simhash")
    parts = fingerprint_components(prints, max_bits, **search)
    lows = prints.groupBy("fp").agg(F.min("id").alias("low")).join(parts, "fp")
    named = lows.join(lows.groupBy("part").agg(F.min("low").alias("component_id")), "part").select("fp", "component_id")
    return (prints.join(named, "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                  max_bits: int = 2, **search) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row
    stays, that with the smallest id (null ids last, one of several rows that
    share the smallest id). All columns stay as they are."""
    names = docs.columns
    rows = saved(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
                 .select("doc", simhash(F.col(f"doc.`{text_col}`"), shingle_words).alias("fp"),
                         F.monotonically_increasing_id().alias("rid")), "simhash-rows")
    parts = fingerprint_components(rows, max_bits, **search)
    id_ = F.col(f"doc.`{id_col}`")
    stays = (rows.select("fp", F.struct(id_.isNull().alias("no_id"), id_.alias("id"), "rid").alias("r"))
             .groupBy("fp").agg(F.min("r").alias("r")).join(parts, "fp")
             .groupBy("part").agg(F.min("r").alias("r")).select(F.col("r.rid").alias("rid")))
    return rows.join(stays, "rid", "left_semi").select("doc.*")
