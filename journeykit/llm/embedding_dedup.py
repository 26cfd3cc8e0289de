"""Embedding near-dedup by int8 quantised tile products.

Equal vectors of a label are one class. A label's classes are dealt into tiles
of a bounded number of rows, and every pair of tiles is one task's work: the
unit vectors are quantised to int8 with one scale each, the tile product is
exact in integers, and by Cauchy-Schwarz

    |x.y - s_x s_y (q_x.q_y)| <= |s_x q_x| e_y + |s_y q_y| e_x + e_x e_y

with e the length of a vector's own quantisation error. Only pairs that this
bound leaves possibly at or above the threshold are computed in double
precision. A task returns link counts and a spanning forest of its links, never
the pairs, so a large group of near copies gives a row per vector, not per pair.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeykit.llm.components import connected_components
from journeykit.llm.storage import saved

LINK_SCHEMA = "a long, b long, n long"


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, the scale, the length of the dequantised
    vector and the length of the error, a row each."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def candidate_pairs(left: tuple, right: tuple, threshold: float):
    """Index pairs whose cosine is possibly >= threshold by the error bound,
    in blocks of rows."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = left, right
    dim = qa.shape[1]
    kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # the sums stay exact integers
    qb_t, rows = qb.astype(kind).T, 256
    for at in range(0, len(qa), rows):
        cut = slice(at, at + rows)
        near = (qa[cut].astype(kind) @ qb_t).astype(np.float64) * sa[cut, None] * sb
        near += na[cut, None] * eb + ea[cut, None] * nb + ea[cut, None] * eb
        i, j = np.nonzero(near >= threshold - 1e-9)
        yield i + at, j


def star_forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that it reaches over the links."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def tile_links(key: tuple, rows: pa.Table, threshold: float) -> pa.Table:
    """Links between the tiles ``lo`` and ``hi`` of one label: rows (class,
    null, linked vectors) and, for the forest, (class, class, null)."""
    lo, hi = key[2].as_py(), key[3].as_py()
    rows = rows.combine_chunks()
    vectors = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    # Scaling by a power of two changes no digit and keeps squares in range.
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    ids, copies, tile = (rows[c].to_numpy() for c in ("cid", "copies", "tile"))
    order = np.argsort(tile, kind="stable")
    vectors, norm, ids, copies = vectors[order], norm[order], ids[order], copies[order]
    split = int((tile == lo).sum()) if lo != hi else 0
    coded = quantise(vectors / norm[:, None])
    first = tuple(x[:split] if lo != hi else x for x in coded)
    linked_i, linked_j = [], []
    for i, j in candidate_pairs(first, tuple(x[split:] for x in coded), threshold):
        j = j + split
        if lo == hi:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            cosine = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b])
            linked_i.append(a[cosine >= threshold])
            linked_j.append(b[cosine >= threshold])
    i = np.concatenate(linked_i or [np.empty(0, int)])
    j = np.concatenate(linked_j or [np.empty(0, int)])
    count = (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
    root = star_forest(len(ids), i, j)
    counted, moved = np.nonzero(count)[0], np.nonzero(root != np.arange(len(ids)))[0]
    none = np.zeros(len(counted) + len(moved), bool)
    is_link = np.concatenate([np.zeros(len(counted), bool), np.ones(len(moved), bool)])
    return pa.table({
        "a": pa.array(np.concatenate([ids[counted], ids[moved]]), pa.int64()),
        "b": pa.array(np.concatenate([ids[counted], ids[root[moved]]]), pa.int64(), mask=~is_link),
        "n": pa.array(np.concatenate([count[counted], none[len(counted):].astype(np.int64)]), pa.int64(),
                      mask=is_link),
    })


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                              label_col: str = "label", threshold: float = 0.98,
                              tile_rows: int = 2048) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``.

    Two rows link if their labels are equal and not null, their vectors have
    the same length and their cosine in double precision is >= ``threshold``.
    Vectors that are null, empty or zero, or hold null, NaN or infinite
    components link with nothing (``n_links`` 0, their own component, kept).
    A repeated row is another vector: it links with its repetition. A null id
    never names a component with other ids; a row with a null id is kept only
    if its component has no id at all. Other columns are not read.

    A task holds at most about ``2 * tile_rows`` vectors. A label of n classes
    costs n squared products and n / ``tile_rows`` copies of its vectors; the
    work grows with the square of the largest label, as the method states.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.col("l").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("l"),
                           F.col(vector_col).cast("array<double>").alias("v"))
            .withColumn("k", F.when(usable, F.col("v"))).drop("v"))
    classes = saved(
        rows.where("k is not null").groupBy("l", F.col("k").alias("v"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
        .withColumn("dim", F.size("v")).withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes")
    tiles = (classes.groupBy("l", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("int").alias("tiles"),
                                             F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    dealt = (classes.join(tiles, ["l", "dim"])
             .withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("l", "dim", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"),
                     "tile", "cid", "copies", "v"))
    found = saved(dealt.groupBy("l", "dim", "lo", "hi")
                  .applyInArrow(lambda key, table: tile_links(key, table, threshold), LINK_SCHEMA), "tile-links")
    counts = found.where("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("b is not null"))
    named = (classes.select("cid", "l", "v", "low", "copies").join(counts, "cid", "left")
             .join(parts.withColumnRenamed("id", "cid"), "cid", "left")
             .withColumn("part", F.coalesce("component", "cid")))
    lowest = named.groupBy("part").agg(F.min("low").alias("component_id"))
    named = (named.join(lowest, "part")
             .select("l", F.col("v").alias("k"), "component_id",
                     (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    lone = F.col("n_links").isNull()
    component = F.when(lone, F.col("id")).otherwise(F.col("component_id"))
    return (rows.join(named, ["l", "k"], "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")))
