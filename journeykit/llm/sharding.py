"""Sharding by proportional stratified interleaving.

Rows are put in a seeded order within each source; a row's fractional rank is
its place in its source, between 0 and 1. Sorted by fractional rank, the
sources interleave in proportion all along the line, so cutting the line into
pieces of equal counts gives shards that all match the mixture.

Neither the ranks nor the sort need one task: a source's rows are dealt into
buckets by hash range, the line into buckets by fractional rank, and a prefix
sum over the bucket sizes makes the ranks within buckets global.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeykit.llm.storage import copy_numbers, saved, source_key

#: Hash range of the seeded order.
SPAN = 1 << 52


def with_rank(rows: DataFrame, group: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """``rows`` with the 0-based rank ``out`` within ``group``, ordered by
    ``bucket`` and then ``order``; and the group's size ``<out>_of``.

    ``bucket`` must cut a group into parts of bounded size. The prefix sum runs
    over the buckets' sizes only, a few numbers for each."""
    sizes = saved(rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("__n")), "bucket-sizes")
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                           F.sum("__n").over(Window.partitionBy(*group)).alias(f"{out}_of"))
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    ranked = rows.withColumn("__r", F.row_number().over(within))
    return (ranked.join(offsets, [*group, bucket]).withColumn(out, F.col("__before") + F.col("__r") - 1)
            .drop("__r", "__before"))


def stratified_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                      source_col: str = "source", seed: int = 42, bucket_rows: int = 8192) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``, one row per input row.

    Counts of shards differ by at most one, and a shard's rows of a source by
    at most a few from the source's share. ``size`` is the text's UTF-8 bytes
    plus one, ``text_crc32`` that of its bytes; a null text counts as empty. A
    null source is a source. Rows with equal ids are ordered by their text;
    rows that repeat as a whole may swap places, which changes no result, and
    are spread over the buckets if they are many. Texts of any length are read
    whole. Other columns are not read. With fewer rows than shards some shards
    stay empty; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    seeded = F.xxhash64(F.lit(seed), F.col("id").cast("string"), "crc", "size", "copy").bitwiseAND(F.lit(SPAN - 1))
    rows = saved(docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("src"),
                             (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc")), "shard-rows")
    rows = saved(copy_numbers(rows, ["id", "src", "crc", "size"], bucket_rows, "copy").withColumn("h", seeded), "shard-seeds")
    counts = saved(rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "source-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    per_source = counts.select("src", F.ceil(F.col("n") / F.lit(bucket_rows)).alias("buckets"))
    rows = (rows.join(per_source, "src")
            .withColumn("hb", F.floor(F.col("h") / F.lit(float(SPAN)) * F.col("buckets")).cast("long")).drop("buckets"))
    rows = with_rank(rows, ["src"], "hb", ["h", "id", "crc", "size", "copy"], "rank")
    # Correctly rounded division: equal fractions are equal doubles.
    buckets = max(1, -(-total // bucket_rows))
    rows = rows.withColumn("f", (2 * F.col("rank") + 1) / (2 * F.col("rank_of")))
    rows = saved(rows.select("id", "src", "size", "crc", "rank", "f", F.lit(0).alias("one"), F.least(
        F.floor(F.col("f") * buckets), F.lit(buckets - 1)).cast("long").alias("fb")), "shard-ranks")
    rows = with_rank(rows, ["one"], "fb", ["f", "src", "rank"], "line")
    return (rows.withColumn("shard", F.expr(f"line * {n_shards} div line_of"))
            .withColumn("slot", F.expr(f"line - (shard * line_of + {n_shards} - 1) div {n_shards}"))
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
                    F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot")))
