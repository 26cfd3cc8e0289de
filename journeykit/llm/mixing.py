"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is dealt in tokens (here: words). Sources get tokens by the highest
quotients target / (2 k + 1), then each source's tokens go to its shards in the
same way, so every shard has an integer quota, however small its source.
Within a shard the documents lie end to end in a seeded order, as a ring; the
quota's whole rounds take everything, and the tokens left are taken from a
seeded block of ``block`` tokens on. So a quota is met to the token, whole documents are taken but
for two at the ends of the cut, and nothing depends on partitions.
"""

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeykit.llm.storage import copy_numbers, saved, small_side, source_key, word_count

MAX_REPEATS = 3
NEW = ["size", "source_size", "target", "rounds", "taken", "cut_from", "cut_size"]


def capped_targets(sizes: list[int], weights: list[float], repeats: int = MAX_REPEATS) -> list[float]:
    """Targets in proportion to the weights that add up to all sizes; a target
    stops at ``repeats`` times its size, and what is above is shared again by
    weight among the rest until none is above."""
    targets, left, free = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > repeats * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(repeats * sizes[i])
        left -= sum(targets[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return targets


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1); ties go to the earlier
    party, none gets more than its cap. Starts from each party's certain part,
    so the number of seats costs nothing."""
    caps = caps or [seats] * len(votes)
    total = sum(votes)
    won = [0] * len(votes)
    if total > 0 and seats > len(votes):
        # With this divisor the rounded quotients add up to no more than the
        # seats, so every seat that it gives is among the highest quotients.
        divisor = total / (seats - len(votes) / 2)
        won = [max(0, min(c, math.floor(v / divisor + 0.5 - 1e-9))) for v, c in zip(votes, caps)]
    queue = [(-v / (2 * w + 1), i) for i, (v, w, c) in enumerate(zip(votes, won, caps)) if v > 0 and w < c]
    heapq.heapify(queue)
    for _ in range(seats - sum(won)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        won[i] += 1
        if won[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * won[i] + 1), i))
    return won


def mix_sources(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
                weights: dict | None = None, seed: int = 42, block: int = 64, shard_docs: int = 8192,
                max_sources: int = 1_000_000, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all if not given) with ``size, source_size, target, rounds, taken, cut_from, cut_size``.

    A row is taken ``rounds`` times as a whole, then ``cut_size`` of its words
    from word ``cut_from`` on (going round to its first word); ``taken`` is the
    sum. ``target`` is its source's. Without ``weights`` (a dict by source)
    the sources in order of code points, null last, weigh 1, 2, 3, repeating;
    a null source is a source. A null or blank text has size 0 and is never
    taken. Rows that repeat are rows of their own. Columns named like the new
    ones are replaced; an empty table gives an empty result.

    The driver gets a row for each source, and raises above ``max_sources``.
    Windows run within a source's shard of about ``shard_docs`` rows.
    """
    names = [c for c in (keep or docs.columns) if c not in NEW]
    spark, text = docs.sparkSession, F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"),
                       source_key(F.col(f"`{source_col}`")).alias("src"), word_count(text).alias("size"),
                       F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), text).alias("h"))
    if text_col not in names:
        rows = saved(rows, "mix-rows")
    # Rows that repeat as a whole are interchangeable; many are spread over the shards.
    rows = copy_numbers(rows.withColumn("whole", F.xxhash64("doc")), ["src", "h", "whole"], shard_docs, "copy")
    rows = rows.withColumn("h", F.when(F.col("copy") == 0, F.col("h")).otherwise(F.xxhash64("h", "copy"))).drop("whole", "copy")
    found = (rows.groupBy("src").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
             .limit(max_sources + 1).collect())
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources")
    found.sort(key=lambda r: r["src"])
    shares = [weights.get(r["src"][1:] if r["src"][0] == "s" else None, 0) if weights else 1 + i % 3
              for i, r in enumerate(found)]
    sizes = [r["size"] for r in found]
    targets = capped_targets(sizes, shares) if sum(shares) else [0.0] * len(sizes)
    dealt = sainte_lague(targets, round(sum(targets)), [MAX_REPEATS * s for s in sizes])
    plan = spark.createDataFrame(
        [(r["src"], r["size"], t, d, max(1, -(-r["n"] // shard_docs))) for r, t, d in zip(found, targets, dealt)],
        "src string, source_size long, target double, dealt long, shards int")
    rows = (rows.join(small_side(plan, len(found)), "src")
            .withColumn("shard", F.pmod(F.xxhash64("h"), F.col("shards")).cast("int")))
    quotas = saved(
        rows.groupBy("src", "shard").agg(F.sum("size").alias("ring"), F.first("dealt").alias("dealt"))
        .groupBy("src").applyInPandas(_shard_quotas, "src string, shard int, ring long, quota long"), "quotas")
    rows = rows.join(small_side(quotas, quotas.count()), ["src", "shard"])

    ring = F.greatest("ring", F.lit(1))
    w = Window.partitionBy("src", "shard").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("doc", "size", "source_size", "target", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("at"),
                       ring.alias("ring"), F.least(F.col("quota"), F.col("ring") * MAX_REPEATS).alias("tokens"),
                       F.pmod(F.xxhash64(F.lit(seed), "src", "shard"), F.ceil(ring / block)).alias("start"))
    # The cut begins at a block's first token and runs for what the whole rounds leave.
    rows = rows.select("doc", "size", "source_size", "target", "ring", "at",
                       F.floor(F.col("tokens") / F.col("ring")).alias("rounds"),
                       (F.col("tokens") % F.col("ring")).alias("length"), (F.col("start") * block).alias("from"))
    end, stop = F.col("at") + F.col("size"), F.col("from") + F.col("length")

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, hi) - F.greatest(F.col("at"), lo))

    straight = overlap(F.col("from"), F.least(stop, F.col("ring")))
    wrapped = overlap(F.lit(0), F.greatest(stop - F.col("ring"), F.lit(0)))
    begin = F.when(straight > 0, F.greatest(F.lit(0), F.col("from") - F.col("at"))).otherwise(F.lit(0))
    return rows.select(*[F.col(f"doc.`{c}`") for c in names], "size", "source_size", "target",
                       F.col("rounds").cast("bigint").alias("rounds"),
                       (F.col("rounds") * F.col("size") + straight + wrapped).cast("bigint").alias("taken"),
                       begin.cast("bigint").alias("cut_from"), (straight + wrapped).cast("bigint").alias("cut_size"))


def _shard_quotas(part: pd.DataFrame) -> pd.DataFrame:
    """A source's tokens over its shards (one row a shard)."""
    part = part.sort_values("shard")
    rings = [int(x) for x in part["ring"]]
    caps = [MAX_REPEATS * x for x in rings]
    return part[["src", "shard", "ring"]].assign(quota=sainte_lague(rings, int(part["dealt"].iloc[0]), caps))


def mixed_documents(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix as rows: each row of ``mix_sources`` as often as it is taken as
    a whole, and once more with the words of its cut if that is not all of it.
    White space within the text stays. Rows not taken go."""
    whole = F.when(F.col("cut_size") == F.col("size"), F.col("rounds") + 1).otherwise(F.col("rounds"))
    part = (F.col("cut_size") > 0) & (F.col("cut_size") < F.col("size"))
    copies = F.concat(F.when(whole > 0, F.array_repeat(F.lit(False), whole.cast("int"))).otherwise(F.array().cast(
        "array<boolean>")), F.when(part, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = mixed.where("taken > 0").withColumn("__part", F.explode(copies))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.slice(pieces, (F.col("cut_from") + 1).cast("int"), F.col("cut_size").cast("int"))
    round_again = F.greatest(F.lit(0), F.col("cut_from") + F.col("cut_size") - F.col("size")).cast("int")
    gap = F.when(round_again > 0, F.lit(" ")).otherwise(F.lit(""))
    cut = F.ltrim(F.concat(F.array_join(first, ""), gap, F.array_join(F.slice(pieces, F.lit(1), round_again), "")))
    return (rows.withColumn(text_col, F.when(F.col("__part"), cut).otherwise(F.col(text_col)))
            .drop("__part", *NEW))
