"""Connected components of a link table, by alternating star contractions.

Each round points every node at the smallest node it knows (first across the
links to larger nodes, then across those to smaller ones). The rounds grow with
the logarithm of the longest chain. A round is two map-side-combined
aggregates and two joins; a hot node only makes a hot join key, which adaptive
execution splits. Nothing is collected but a count and a checksum.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from journeykit.llm.storage import saved


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every node of ``links`` (long columns ``a`` and
    ``b``) that is not its component's smallest node.

    Null ends, loops and repeated links are ignored; no links give no rows.
    """
    edges = saved(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links")
    state = _checksum(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        edges = saved(small, "links")
        before, state = state, _checksum(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
