"""Toxicity scores by a linear softmax over averaged subword embeddings.

A text is the bag of its words' character n-grams (``<`` and ``>`` mark a
word's ends; the whole word is one more), hashed into buckets. Each bucket has
an embedding; a text is the average of those of its n-grams, each weighted by
the square of its log inverse document frequency, and a linear softmax tells
its class. Embeddings and softmax are trained jointly, by
gradient steps in numpy over a bounded sample of labelled texts. A misspelling
that was never seen shares most n-grams, and so vectors, with the word it is of.

The classes' logits of an average are the average of the n-grams' logits, so a
model is applied as one number per bucket and class: a text is scored whole, in
one pass over its words, each distinct word looked up once.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from journeykit.llm.storage import bounded_batches, saved

GRAMS = (3, 4, 5)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Units in which bucket logits are summed: integers, so that sums do not depend on their order.
UNIT = 1 << 20
#: Characters of texts that are worked on at a time, words that a worker remembers and their characters.
BLOCK = 1 << 19
REMEMBERED = 1 << 18
REMEMBERED_CHARS = 1 << 23
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
NEXT_SPACE = re.compile(r"\s")


# ---- words and n-grams --------------------------------------------------------

def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text in lower case, without ASCII punctuation at their
    ends, a block at a time. Only a run of more than a block's characters
    without white space may be cut, into words of their own."""
    text, at = (text or "").lower(), 0
    while at < len(text):
        found = NEXT_SPACE.search(text, at + BLOCK, at + 2 * BLOCK)
        end = found.start() if found else min(at + 2 * BLOCK, len(text))
        yield [w for w in (x.strip(EDGES) for x in text[at:end].split()) if w]
        at = end


def word_grams(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every n-gram of the words, and of every word itself."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    own = np.repeat(np.arange(len(words)), length)
    start = np.cumsum(length) - length
    left = np.repeat(start + length, length) - np.arange(len(codes))       # letters from here to the word's end
    owners, buckets = [], []

    def add(mine, key):
        owners.append(mine)
        buckets.append(((key ^ (key >> np.uint64(29))) * FACTOR >> np.uint64(64 - bits)).astype(np.int32))

    key = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        fits = max(len(codes) - n + 1, 0)
        key = key[:fits] * FACTOR + codes[n - 1:n - 1 + fits] + np.uint64(1)
        if n in GRAMS:
            whole = left[:fits] >= n
            add(own[:fits][whole], key[whole] + np.uint64(n))
    power = np.cumprod(np.full(int(length.max(initial=1)), FACTOR))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[np.arange(len(codes)) - start[own]])])
    add(np.arange(len(words)), (total[start + length] - total[start]) * FACTOR)
    return np.concatenate(owners), np.concatenate(buckets)


def text_bag(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A text's distinct buckets, how often it has each, and its number of n-grams."""
    held = np.empty(0, np.int32), np.empty(0, np.int64)
    for words in words_of(text):
        if words:
            own, times = np.unique(word_grams(words, bits)[1], return_counts=True)
            bucket, at = np.unique(np.concatenate([held[0], own]), return_inverse=True)
            held = bucket, np.bincount(at, np.concatenate([held[1], times])).astype(np.int64)
    return *held, int(held[1].sum())


# ---- training -----------------------------------------------------------------

def train(texts: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, size: int = 8, rounds: int = 60,
          patience: int = 15, steps: tuple[float, float] = (10.0, 0.05), momentum: float = 0.9,
          seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """``(buckets, logit of each, bias)``, class 1 less class 0.

    ``texts`` are the buckets of each text, ``weights`` their weighted shares
    of the text's n-grams. Embeddings (``size`` numbers a bucket) and the softmax over
    the two classes take joint steps over all texts, with momentum; a step's
    length is ``steps`` over the gradient's largest norm so far. Every fifth
    text is kept back, and the round that codes these best counts; after
    ``patience`` rounds without a better one it ends."""
    n = len(texts)
    prior = math.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))
    buckets, at = np.unique(np.concatenate(texts), return_inverse=True) if n else (np.empty(0, np.int32), np.empty(0, int))
    if not len(buckets) or labels.min() == labels.max():
        return buckets, np.zeros(len(buckets)), prior
    own = np.repeat(np.arange(n), [len(t) for t in texts])
    share = np.concatenate(weights)
    kept_back = np.arange(n) % 5 == 4
    part = ~kept_back / max((~kept_back).sum(), 1)
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.1 / math.sqrt(size), (len(buckets), size))
    softmax = random.normal(0, 0.1 / math.sqrt(size), (size, 2))
    bias = np.array([0.0, prior])
    moving = [np.zeros_like(embedding), np.zeros_like(softmax), np.zeros(2)]
    norms = [0.0, 0.0]
    best, since = (math.inf, None, prior), 0
    for at_round in range(rounds):
        logit = embedding @ (softmax[:, 1] - softmax[:, 0])
        margin = np.bincount(own, share * logit[at], minlength=n) + bias[1] - bias[0]
        loss = np.logaddexp(0, np.where(labels == 1, -margin, margin))
        if (held := loss[kept_back if kept_back.any() else slice(None)].mean()) < best[0]:
            best, since = (held, logit, bias[1] - bias[0]), at_round
        elif at_round - since >= patience:
            break
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels) * part
        per_bucket = np.bincount(at, share * error[own], minlength=len(buckets))
        slopes = [np.outer(per_bucket, softmax[:, 1] - softmax[:, 0]),
                  np.stack([-(embedding.T @ per_bucket), embedding.T @ per_bucket], 1),
                  np.array([-error.sum(), error.sum()])]
        norms = [max(0.99 * old, float(np.linalg.norm(g)), 1e-12) for old, g in zip(norms, slopes)]
        for i, scale in enumerate((steps[0] / norms[0], steps[1] / norms[1], 1.0)):
            moving[i] = momentum * moving[i] - scale * slopes[i]
        embedding, softmax, bias = embedding + moving[0], softmax + moving[1], bias + moving[2]
    return buckets, best[1], float(best[2])


def _sampled_bags(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bucket, count, n = text_bag(text, bits)
                ends = pa.array([0, len(bucket)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(bucket)),
                     pa.ListArray.from_arrays(ends, pa.array((count / max(n, 1)).astype(np.float32)))], ["label", "bucket", "share"])
    return run


def learn(docs: DataFrame, labels: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_docs: int = 3000, bits: int = 20, least_share: float = 0.005, least_docs: int = 3,
          most_share: float = 0.3) -> dict:
    """A model of ``label_col`` (1, or any other number) learned from the
    ``docs`` where ``rows`` holds and that have a label.

    It is fitted to a sample of at most ``max_docs`` distinct texts, the ones
    of smallest hash; copies count once, with the largest of their labels.
    N-grams of fewer than ``least_docs`` or ``least_share`` of these texts, or
    of more than ``most_share``, keep the vector zero: so at most
    ``most_share * max_docs * 2 ** bits`` entries reach the driver. Null labels
    teach nothing; without labelled rows, or with one class, the model is the
    prior. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("label")))
    hashes = docs.where(rows).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    sample = saved(hashes.join(told, "id").groupBy("hash").agg(F.max("label").alias("label"))
                   .orderBy(F.xxhash64("hash"), "hash").limit(max_docs), "label-sample")
    # At most max_docs rows of two numbers.
    texts = (docs.where(rows).select(text.alias("text"), F.xxhash64(text).alias("hash"))
             .join(F.broadcast(sample), "hash").groupBy("hash", "label").agg(F.first("text").alias("text")))
    bags = saved(texts.select("hash", "label", "text").select("label", "text").mapInArrow(
        _sampled_bags(bits), "label int, bucket array<int>, share array<float>"), "label-bags")
    n = bags.count()
    least, most = max(least_docs, math.ceil(least_share * n)), max(least_docs, int(most_share * n))
    used = (bags.select(F.explode("bucket").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("docs"))
            .where(F.col("docs").between(least, most)).toArrow())
    weight = np.zeros(1 << bits, np.float32)
    weight[used["bucket"].to_numpy()] = np.log(max(n, 1) / used["docs"].to_numpy()) ** 2
    shared = spark.sparkContext.broadcast(weight)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, bucket, share in zip(*batch.columns):
                bucket = bucket.values.to_numpy()
                share = share.values.to_numpy() * shared.value[bucket]
                some = share > 0
                rows.append((label.as_py(), bucket[some].tobytes(), share[some].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                             ["label", "bucket", "share"])

    # In an order of their own, so that reruns train alike.
    found = sorted((r["bucket"], r["share"], r["label"]) for r in
                   bags.mapInArrow(kept, "label int, bucket binary, share binary").toArrow().to_pylist())
    buckets, logit, bias = train([np.frombuffer(b, np.int32) for b, _, _ in found],
                                 [np.frombuffer(s, np.float32).astype(np.float64) for _, s, _ in found],
                                 np.array([y for _, _, y in found], np.int64))
    logits = np.zeros(1 << bits, np.int64)
    logits[buckets] = np.rint(logit * weight[buckets] * UNIT).astype(np.int64)
    return {"bits": bits, "logits": logits, "bias": bias}


# ---- scores -------------------------------------------------------------------

class WordLogits:
    """Sums of logits and numbers of n-grams of words; each new word is worked out once."""

    def __init__(self, bits: int, logits: np.ndarray):
        self.bits, self.logits = bits, logits
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.counts, self.chars = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        own, bucket = word_grams(new, self.bits)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(len(new)))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.sums = np.append(self.sums, np.add.reduceat(self.logits[bucket[order]], starts))
        self.counts = np.append(self.counts, np.bincount(own, minlength=len(new)))
        self.chars += sum(map(len, new))

    def total(self, words: list[str]) -> tuple[int, int]:
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return int(self.sums[at].sum()), int(self.counts[at].sum())

    def margins(self, texts: list[str | None]) -> list[float]:
        """The average logit of each text's n-grams; 0 without any."""
        totals = [[0, 0] for _ in texts]
        held, size = [], 0

        def flush():
            if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
                self.forget()
            self.learn(set().union(*[words for _, words in held]))
            for i, words in held:
                logit, count = self.total(words)
                totals[i][0] += logit
                totals[i][1] += count

        for i, text in enumerate(texts):
            for words in words_of(text):
                held.append((i, words))
                size += sum(map(len, words))
                if size > BLOCK:
                    flush()
                    held, size = [], 0
        flush()
        return [logit / count / UNIT if count else 0.0 for logit, count in totals]


def score(text: Column, model: dict, spark) -> Column:
    """Probability of class 1 of a text column. Null, empty and blank texts
    have no n-grams: theirs is that of the bias alone. Whole texts are read, a
    block of words at a time; equal texts have equal scores."""
    shared = spark.sparkContext.broadcast(model)

    def batch(texts: pa.Array) -> pa.Array:
        held = shared.value
        if "words" not in held:
            held["words"] = WordLogits(held["bits"], held["logits"])
        margin = np.array(held["words"].margins(texts.to_pylist())) + held["bias"]
        return pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))))

    return arrow_udf(batch, "double")(text)
