"""Queries over the dealt operators, and DuckDB SQL where SQL can express one."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from journeykit.llm import (arc_warc, ctw, embedding_dedup, langid, lexical_search, line_dedup, mixing, order_minhash,
                            sharding, simhash, sp_bpe, spelling, toxicity)
from journeykit.llm.storage import id_bucket

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    LLM_QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.embedding_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query
def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_bucket("doc_id", 3) == 1
    filters = langid.learn_filters(docs, train=~held_out)
    return (langid.identify_language(docs.select("doc_id", "text", held_out.alias("held_out")), filters)
            .select("doc_id", "held_out", "lang_pred", "score"))


@query
def op4_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate_lines(docs, max_ratio=0.01, min_pages=3)


@query
def op5_order_minhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("tie", F.xxhash64("text"))
    rows = order_minhash.add_fingerprint(rows, "text", "own")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = order_minhash.with_next(rows, "doc_id", {"text": "next_text", "own": "next_own"}, ["text"], buckets, spread="tie")
    # The last document's next is the first: with_next goes round.
    take = F.expr("n_chars div 3").cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 3 as int))"),
                      F.substring("next_text", F.lit(1), take))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", edited.alias("edited"))
    rows = order_minhash.add_fingerprint(rows, "edited", "changed")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.fingerprint_text("own").alias("fingerprint"),
        order_minhash.fingerprint_text("changed").alias("edited_fingerprint"),
        order_minhash.likeness("own", "changed").alias("near_edited"),
        order_minhash.likeness("own", "next_own").alias("near_next"))


@query
def op6_arc_to_warc(spark, sf_dir):
    return arc_warc.pages_through_archives(table(spark, sf_dir, "pages"))


@query
def op7_sentencepiece_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    codec = sp_bpe.share_codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = docs.select("doc_id", sp_bpe.encode(F.col("text"), codec).alias("ids"))
    rows = rows.select("doc_id", "ids", sp_bpe.decode(F.col("ids"), codec).alias("decoded"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_mix_sources(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_context_tree_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ctw.score_documents(docs, train=id_bucket("doc_id", 7) != 2)
    return scored.select("doc_id", (id_bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


@query
def op10_stratified_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sharding.stratified_shards(docs, n_shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_bucket("doc_id", 5) == 0
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), rows=~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), min_length=5, min_count=3, ratio=2, every=97)


@query
def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


LLM_ORACLE_SQL = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
               AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM part LEFT JOIN deg USING (vec_id)""",
    "op4_line_dedup": """
        WITH page AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
        total AS (SELECT source, count(*) AS pages FROM page GROUP BY source),
        line AS (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM page),
        bad AS (SELECT l.source, l.line FROM (SELECT source, line, count(*) AS n FROM line WHERE trim(line) <> ''
                                              GROUP BY source, line) l
                JOIN total t ON l.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n / pages > 0.01::DOUBLE),
        part AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        marked AS (SELECT p.*, b.line IS NOT NULL AS gone FROM part p
                   LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source AND p.line = b.line),
        done AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
                        count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM marked GROUP BY doc_id)
        SELECT d.doc_id, done.text, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
        FROM documents d LEFT JOIN done USING (doc_id)""",
    "op6_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        w AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM w""",
    "op13_lexical_search": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms FROM documents),
        total AS (SELECT count(*) FILTER (len(terms) > 0) AS N, sum(len(terms))::BIGINT AS L FROM d),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
        weight AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
                   FROM tf, total GROUP BY term, N),
        item AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
        m AS (SELECT doc_id, 25 + (75 * len(terms) * N) // L AS m FROM d, total WHERE len(terms) > 0),
        scored AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM (SELECT item_id, term, count(*) AS times FROM item GROUP BY ALL)
            JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (doc_id) GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
                   FROM scored WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
