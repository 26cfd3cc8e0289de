"""A training-data pipeline over ``documents``, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage
before kept, and returns a DataFrame that is written as Parquet and read again
by the next. All but the last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeykit.llm import langid, line_dedup, mixing, simhash, sp_bpe
from journeykit.llm.storage import bounded_batches, id_bucket, saved

#: Documents whose best language has a smaller corrected share of n-grams are rejected.
LEAST_LANGUAGE_SCORE = 0.3


def _columns(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the number of characters counted anew."""
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return result.select(*[f"`{c}`" for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the predicted language; documents without a letter, or
    that no learned language explains, go."""
    bounded_batches(spark)
    filters = langid.learn_filters(docs, train=id_bucket("doc_id", 3) != 1)
    told = langid.identify_language(docs, filters, lang_out="_lang", score_out="_score")
    kept = told.where((F.col("_lang") != langid.UNDETERMINED) & (F.col("_score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("_lang")).select(*[f"`{c}`" for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its texts; every document stays."""
    return _columns(line_dedup.drop_boilerplate_lines(docs, max_ratio=0.01, min_pages=3), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    bounded_batches(spark)
    return simhash.simhash_dedup(docs, shingle_words=3, max_bits=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight takes them; at the two ends
    of a shard's cut a document is taken in part."""
    return _columns(mixing.mixed_documents(mixing.mix_sources(docs)), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether decoding them gives the text's bytes back."""
    bounded_batches(spark)
    codec = sp_bpe.share_codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = docs.select("doc_id", "lang", "source", "text", sp_bpe.encode(F.col("text"), codec).alias("ids"))
    back = sp_bpe.decode(F.col("ids"), codec) == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                       back.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix),
    ("bpe", tokenize),
]

#: SQL cannot express the first, third and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
