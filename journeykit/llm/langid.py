"""Language ID by bit-sliced Bloom filters of letter n-grams.

Every language has a Bloom filter of its n-grams. The filters are stored bit
sliced: one table of slots whose words have a bit per language, so the AND of
an n-gram's few slots is the bit mask of all languages that (may) contain it.
A text's n-grams are counted per language by those bits. A language whose
filter has a share ``f`` of false positives is expected to get ``n f`` of n
absent n-grams, so its count c is corrected to (c - n f) / (1 - f); the largest
corrected share decides.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

UNDETERMINED = "und"
HASHES = 3
WINDOW = 1 << 19
#: Characters that are looked at together.
BLOCK = 1 << 19


@dataclass
class NgramFilters:
    """Learned filters: ``slots`` (words, slot) with a bit per language."""

    languages: list[str]
    slots: np.ndarray
    orders: tuple[int, ...]
    broadcast: object = None


def letter_table() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_stream(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts in one array, every run of other
    characters as one 0, a 0 before and after each text; and where each text
    begins (one more at the end)."""
    parts, starts = [], [0]
    for text in texts:
        codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), "<u4")
        codes = np.where(letters[codes], codes, 0)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        parts.append(codes[keep])
        starts.append(starts[-1] + len(parts[-1]))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), np.array(starts)


def ngram_windows(codes: np.ndarray, orders: tuple[int, ...]):
    """(position, hash) arrays of the n-grams that lie within a word and its
    two borders, in windows of bounded length."""
    for at in range(0, len(codes), WINDOW):
        part = codes[at:at + WINDOW + max(orders) - 1].astype(np.uint64)
        for order in orders:
            n = min(len(part) - order + 1, WINDOW)
            if n <= 0:
                continue
            inner = np.ones(n, bool)
            for j in range(1, order - 1):
                inner &= part[j:j + n] != 0
            inner &= (part[:n] != 0) | (part[order - 1:order - 1 + n] != 0) | (order > 2)
            where = np.nonzero(inner)[0]
            value = np.full(len(where), order, np.uint64)
            for j in range(order):
                value = value * np.uint64(0x9E3779B97F4A7C15) + part[where + j]
                value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            yield where + at, value ^ (value >> np.uint64(32))


def blocks(texts: list[str | None]):
    """The texts in order, in lists of about ``BLOCK`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "") + 2
        if size > BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_ngrams(batches, orders: tuple[int, ...]):
    """Arrow batches (language number, text) to batches (language number,
    n-gram, count), summed within a batch and window."""
    letters = letter_table()
    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1).to_pylist()
        for number in np.unique(numbers):
            for block in blocks([texts[i] for i in np.nonzero(numbers == number)[0]]):
                codes, _ = letter_stream(block, letters)
                found = [np.empty(0, np.uint64), *(grams for _, grams in ngram_windows(codes, orders))]
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), number, np.int32)), pa.array(gram.view(np.int64)),
                     pa.array(n.astype(np.int64))], ["number", "gram", "n"])


def learn_filters(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train: Column | None = None,
                  max_docs: int = 4000, orders: tuple[int, ...] = (3, 4), min_rate: float = 1e-5,
                  relative: float = 0.1, slots: int = 1 << 20, max_languages: int = 1024) -> NgramFilters:
    """Fit the filters on the labelled rows where ``train`` holds.

    Equal texts of a language count once. Of a language with more than
    ``max_docs`` distinct texts a sample of about that many is read, chosen by
    a hash of the text. An n-gram enters a
    language's filter if it makes up at least ``min_rate`` of that language's
    n-grams (so a filter holds at most 1 / ``min_rate`` of each order) and at
    least ``relative`` of its largest rate in any language. The filters are the
    only thing that reaches the driver: ``slots`` words for each 64 languages.
    Null texts and null labels teach nothing.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = (rows if train is None else rows.where(train)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    copies = rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    sizes = (copies.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
             .limit(max_languages + 1).collect())
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    found = sorted(sizes, key=lambda r: (-r["n"], r["lang"]))  # ties go to the more frequent
    languages, words = [r["lang"] for r in found], -(-max(1, len(found)) // 64)
    table = np.zeros((words, slots), np.uint64)
    if found:
        spark = docs.sparkSession
        share = spark.createDataFrame(
            [(r["lang"], i, int(min(1.0, max_docs / r["texts"]) * 1_000_000)) for i, r in enumerate(found)],
            "lang string, number int, share int")
        sample = (rows.join(F.broadcast(share), "lang")
                  .where(F.pmod("h", F.lit(1_000_000)) < F.col("share"))
                  .groupBy("number", "h").agg(F.first("text").alias("text")).select("number", "text"))
        grams = (sample.mapInArrow(lambda batches: count_ngrams(batches, orders), "number int, gram long, n long")
                 .groupBy("number", "gram").agg(F.sum("n").alias("n")))
        total = grams.groupBy("number").agg(F.sum("n").alias("total"))
        rated = grams.join(F.broadcast(total), "number").withColumn("rate", F.col("n") / F.col("total"))
        rated = rated.where(F.col("rate") >= min_rate)
        best = rated.groupBy("gram").agg(F.max("rate").alias("best"),
                                         F.collect_list(F.struct("number", "rate")).alias("by"))
        members = (best.select("gram", "best", F.explode("by").alias("m"))
                   .where(F.col("m.rate") >= relative * F.col("best")).select("gram", "m.number"))
        bits = slots.bit_length() - 1
        at = F.explode(F.array(*[F.shiftrightunsigned("gram", bits * i).bitwiseAND(F.lit(slots - 1))
                                 for i in range(HASHES)]))
        one = F.expr("shiftleft(1L, number % 64)")
        filled = (members.select(at.alias("slot"), F.floor(F.col("number") / 64).alias("word"), one.alias("bit"))
                  .groupBy("word", "slot").agg(F.bit_or("bit").alias("mask"))).toArrow()
        table[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    if len(languages) <= 8:
        table = table.astype(np.uint8)
    return NgramFilters(languages, table, orders)


def classify(texts: list[str | None], filters: dict, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number (-1: undetermined) and corrected share of each text."""
    slots, number = filters["slots"], filters["languages"]
    codes, starts = letter_stream(texts, letters)
    total, hits = np.zeros(len(texts)), np.zeros((max(1, number), len(texts)))
    size = np.uint64(slots.shape[1] - 1)
    bits = np.uint64(slots.shape[1].bit_length() - 1)
    kind = slots.dtype.type
    for where, grams in ngram_windows(codes, filters["orders"]):
        doc = np.searchsorted(starts, where, "right") - 1
        first = np.concatenate([[0], np.nonzero(np.diff(doc))[0] + 1]) if len(doc) else np.empty(0, int)
        own = doc[first]
        total[own] += np.diff(np.append(first, len(doc)))
        at = [((grams >> (bits * np.uint64(i))) & size).astype(np.int64) for i in range(HASHES)]
        for word in range(slots.shape[0] if number else 0):
            mask = slots[word][at[0]] & slots[word][at[1]] & slots[word][at[2]]
            for bit in range(min(64, number - 64 * word)):
                has = (mask >> kind(bit)) & kind(1)
                hits[64 * word + bit, own] += np.add.reduceat(has, first, dtype=np.int64) if len(first) else 0
    wrong = filters["false_rate"][:, None] if number else np.zeros((1, 1))
    share = np.clip((hits - total * wrong) / (1 - wrong) / np.maximum(total, 1), 0, 1)
    best = share.argmax(axis=0)
    known = (total > 0) & (number > 0)
    return np.where(known, best, -1), np.where(known, share[best, np.arange(len(texts))], 0.0)


def predict_language(text: Column, filters: NgramFilters, spark) -> Column:
    """Struct ``(lang, score)`` for a text column: a learned language and its
    corrected share of the text's n-grams (0 to 1). A null text, or one without
    a letter, is ``und`` with score 0, as is every text if nothing was learned.
    Ties go to the language with more training rows, then the smaller name."""
    number = len(filters.languages)
    if filters.broadcast is None:
        fill = np.array([((filters.slots[i // 64] >> filters.slots.dtype.type(i % 64)) & 1).mean()
                         for i in range(number)])
        filters.broadcast = spark.sparkContext.broadcast({
            "slots": filters.slots, "languages": number, "orders": filters.orders, "false_rate": fill ** HASHES})
    shared, names = filters.broadcast, [*filters.languages, UNDETERMINED]

    def batch(texts: pa.Array) -> pa.Array:
        state = shared.value
        if "letters" not in state:
            state["letters"] = letter_table()
        told = [classify(block, state, state["letters"]) for block in blocks(texts.to_pylist())]
        best, score = (np.concatenate(x) for x in zip(*told)) if told else (np.empty(0, int), np.empty(0))
        return pa.StructArray.from_arrays([pa.array(names).take(pa.array(best % len(names))), pa.array(score)],
                                          ["lang", "score"])

    # Called non-deterministic so that a filter on the result is not pushed below it, which would compute it twice.
    return arrow_udf(batch, "lang string, score double").asNondeterministic()(text)


def identify_language(docs: DataFrame, filters: NgramFilters, text_col: str = "text",
                      lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score. Columns of those
    names are replaced, all others stay; an empty table stays empty."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (lang_out, score_out)]
    told = predict_language(F.col(f"`{text_col}`"), filters, docs.sparkSession)
    rows = docs.select(F.struct(*kept, F.lit(None).alias("__none")).alias("doc"), told.alias("told"))
    return rows.select("doc.*", F.col("told.lang").alias(lang_out), F.col("told.score").alias(score_out)).drop("__none")
