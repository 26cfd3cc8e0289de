"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, most significant bit first; a decision is
known by the bits of the byte so far. Each has a context tree over the bytes
before: the node of a context of d bytes holds how often the bit was 0 and 1
there, and estimates it by Krichevsky-Trofimov. With P_e the estimator's
probability of all that a node has seen,

    P_w = 1/2 P_e + 1/2 prod(P_w of its children),

so a prediction mixes the estimates of all depths along the context, weighted
by how well each depth has coded the training text. The tree has the contexts
that occur at least ``least`` times; what a node has seen in rarer contexts is
one more child, used for those and for contexts never seen.

The tree grows with the corpus and is nowhere held whole. Its grams (a byte
and its context) are dealt by the nearest ``SPLIT`` bytes of context, so a
part holds whole subtrees. One pass over the parts sums the subtrees' P_w; the
driver weighs the contexts above them, whose number is bounded by the bytes
there are; a second pass takes the mixture down again and gives the
probability of every gram that any text has. Texts are scored with those of
the most frequent grams, a bounded table that is broadcast; a text's other
grams are counted and joined with theirs. Where a gram is looked up changes
its score by rounding only.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from journeykit.llm.storage import bounded_batches, saved

WINDOW = 1 << 19
EMPTY = np.uint64((1 << 64) - 1)
LOG10_2 = math.log10(2)
#: Subtrees begin at contexts of so many bytes.
SPLIT = 3
#: Spreads contexts over parts; a product with SPLIT bytes stays below 2 ** 56.
MIX = 2654435761
#: Grams in a packed array.
PACKED = 4096
#: Units of log2 in which probabilities are stored.
UNIT = 1 << 20


# ---- byte grams -------------------------------------------------------------

def model_bytes(text: bytes | None) -> bytes:
    """What is scored: the words of the text lower-cased in A-Z, a space
    between, and a newline as the end."""
    return b" ".join((text or b"").lower().split()) + b"\n"


def gram_windows(texts: list[bytes], depth: int):
    """(index of the text, gram) arrays in windows of bounded length. A gram
    holds a byte and, above it, the ``depth`` bytes before (newlines before the
    first), the nearest lowest: the eight bytes up to it, read as one big-endian
    number, without those that are too far."""
    if not texts:
        return
    pad = b"\n" * depth
    # Eight bytes are read at every place, so something must stand before the first.
    before = bytes(7 - depth)
    data = before + pad + pad.join(texts)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths + depth) - lengths + len(before)
    near = np.uint64(low_bits(8 * (depth + 1)))
    for at in range(7, len(data), WINDOW):
        end = min(at + WINDOW, len(data))
        gram = np.empty(end - at, np.uint64)
        for k in range(min(8, end - at)):
            gram[k::8] = np.ndarray((end - at - k + 7) // 8, ">u8", data, at - 7 + k, 8)
        gram &= near
        lo, hi = np.searchsorted(starts, (at, end - 1), "right") - 1
        lo = max(lo, 0)
        first = np.maximum(starts[lo:hi + 1], at)
        rows = np.maximum(np.minimum(starts[lo:hi + 1] + lengths[lo:hi + 1], end) - first, 0)
        own = np.repeat(np.arange(lo, hi + 1), rows)
        if len(own) < len(gram):
            real = np.zeros(len(gram) + 1, np.int8)
            some = rows > 0
            real[first[some] - at] += 1
            real[first[some] + rows[some] - at] -= 1
            gram = gram[np.cumsum(real[:-1], dtype=np.int8).view(bool)]
        yield own, gram


def _sum_grams(held: list) -> tuple[np.ndarray, np.ndarray]:
    grams, n = np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held])
    order = np.argsort(grams)
    grams = grams[order]
    first = np.nonzero(np.concatenate([np.ones(min(len(grams), 1), bool), grams[1:] != grams[:-1]]))[0]
    return grams[first], np.add.reduceat(n[order], first).astype(np.int64) if len(first) else np.empty(0, np.int64)


def part_of(gram: np.ndarray, bits: int) -> np.ndarray:
    """One of 2 ** ``bits`` parts, by the nearest ``SPLIT`` bytes of a gram's context."""
    nearest = (gram >> np.uint64(8)) & np.uint64(low_bits(8 * SPLIT))
    return ((nearest * np.uint64(MIX) >> np.uint64(32 - bits)) & np.uint64(low_bits(bits))).astype(np.int32)


def part_column(bits: int) -> Column:
    """``part_of`` for the column ``gram``."""
    nearest = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(low_bits(8 * SPLIT)))
    return F.shiftrightunsigned(nearest * F.lit(MIX), 32 - bits).bitwiseAND(F.lit(low_bits(bits))).cast("int")


def planes(numbers: np.ndarray) -> bytes:
    """8-byte numbers as eight planes of bytes, which compress well: the high ones are mostly runs."""
    return numbers.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(kind)[:, 0]


def count_grams(batches, depth: int, bits: int, most: int = 1 << 20):
    """Arrow batches (text, whether it teaches) to batches (part, grams, n):
    arrays of at most ``PACKED`` grams of a part and of their counts in
    teaching texts, as bytes; summed within a task as far as ``most`` distinct
    grams fit."""
    def out(held):
        grams, n = _sum_grams(held)
        part = part_of(grams, bits)
        order = np.argsort(part, kind="stable")
        grams, n, part = grams[order], n[order], part[order]
        cuts = np.nonzero(np.diff(part))[0] + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
            for at in range(lo, hi, PACKED):
                yield int(part[at]), planes(grams[at:min(at + PACKED, hi)]), planes(n[at:min(at + PACKED, hi)])

    def packed(held):
        rows = list(out(held))
        for at in range(0, len(rows), 256):
            columns = zip(*rows[at:at + 256])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))],
                                             ["part", "grams", "n"])

    held, size = [], 0
    for batch in batches:
        texts = [model_bytes(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        taught = batch.column(1).to_pylist()
        for teaches in (True, False):
            for _, gram in gram_windows([t for t, own in zip(texts, taught) if own == teaches], depth):
                grams, n = np.unique(gram, return_counts=True)
                held.append((grams, n * teaches))
                size += len(grams)
                if size > most:
                    held = [_sum_grams(held)]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield from packed(held)
                        held, size = [], 0
    if size:
        yield from packed(held)


def merge_grams(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """A part's packed arrays, one batch after the other, to its distinct grams and their counts."""
    held, size, most = [], 0, 1 << 20
    for batch in batches:
        for grams, n in zip(batch.column("grams").to_pylist(), batch.column("n").to_pylist()):
            held.append((unplaned(grams, np.uint64), unplaned(n, np.int64)))
            size += len(held[-1][0])
        if size > 2 * most:
            held = [_sum_grams(held)]
            size = most = max(most, len(held[0][0]))
    return _sum_grams(held)


def columns_of(names: str, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of the columns ``names``, null where not given."""
    size = len(next(iter(columns.values())))
    for at in range(0, size, 1 << 16):
        rows = min(1 << 16, size - at)
        yield pa.RecordBatch.from_arrays([
            pa.array(columns[c][at:at + rows]) if c in columns else pa.nulls(rows, pa.float64() if c == "log" else pa.int64())
            for c in names.split()], names.split())


def low_bits(n: int) -> int:
    return (1 << n) - 1


# ---- the tree, in arrays ------------------------------------------------------

def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: the recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, np.float64)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple:
    """Open addressing over distinct uint64 keys: plain arrays, so that a worker needs no class to load them."""
    bits = max(8, int(1.5 * len(keys)).bit_length())
    held, stored = np.full(1 << bits, EMPTY, np.uint64), np.zeros(1 << bits, np.float32)
    probes, left, first = 0, np.arange(len(keys)), slots(keys, bits)
    while len(left):
        at = (first[left] + probes) & low_bits(bits)
        free = held[at] == EMPTY
        held[at[free]] = keys[left[free]]
        placed = held[at] == keys[left]
        stored[at[placed]] = values[left[placed]]
        left = left[~placed]
        probes += 1
    return bits, probes, held, stored


def find(table: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where absent) and whether each key is there, an array of keys at a time."""
    bits, probes, held, stored = table
    at = slots(keys, bits)
    got = held[at]
    found = got == keys
    values = np.where(found, stored[at], np.float32(0))
    left = np.nonzero(~found & (got != EMPTY))[0]
    for probe in range(1, probes):
        if not len(left):
            break
        at_left = (at[left] + probe) & low_bits(bits)
        got = held[at_left]
        hit = got == keys[left]
        found[left[hit]] = True
        values[left[hit]] = stored[at_left[hit]]
        left = left[~hit & (got != EMPTY)]
    return values, found


def _bit_nodes(context: np.ndarray, byte: np.ndarray, t: int) -> np.ndarray:
    """Keys of the t-th decision: the context, and 1 followed by the byte's first t bits."""
    return context << np.uint64(8) | np.uint64(1 << t) | (byte >> np.uint64(8 - t))


def _bits(byte: np.ndarray, t: int) -> np.ndarray:
    return (byte >> np.uint64(7 - t)) & np.uint64(1)


def shorter(key: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the same decisions in the last ``depth`` bytes of their contexts."""
    return key & np.uint64(low_bits(8 * (depth + 1)))


def kept_levels(grams: np.ndarray, n: np.ndarray, low: int, depth: int, least: int) -> list[tuple]:
    """(d, grams of d + 1 bytes, counts) for d from ``low`` to ``depth``, of the
    contexts of d bytes that occur at least ``least`` times (the empty one
    always). A context that is kept has its shorter ones kept."""
    out, taught = [], n > 0
    grams, n = grams[taught], n[taught]
    for d in range(low, depth + 1):
        own, at = np.unique(shorter(grams, d), return_inverse=True)
        count = np.bincount(at, n, len(own))
        contexts, of = np.unique(own >> np.uint64(8), return_inverse=True)
        kept = (np.bincount(of, count, len(contexts)) >= least)[of] | (d == 0)
        if not kept.any():
            break
        out.append((d, own[kept], count[kept]))
    return out


def sums_by_parent(x: dict) -> tuple:
    """Keys of the nodes one byte up, and their children's zeros, ones and log P_w."""
    key, at = np.unique(shorter(x["key"], x["depth"] - 1), return_inverse=True)
    return key, *[np.bincount(at, x[c], len(key)) for c in ("a", "b", "log")]


def climb(levels: list[tuple], children: tuple | None = None) -> list[dict]:
    """The nodes of consecutive levels, weighed from the deepest up.
    ``children`` are the sums below the deepest level, if any are elsewhere."""
    nodes = []
    for d, grams, n in levels:
        byte, context = grams & np.uint64(255), grams >> np.uint64(8)
        key, at = np.unique(np.concatenate([_bit_nodes(context, byte, t) for t in range(8)]), return_inverse=True)
        seen, ones = np.tile(n, 8), np.concatenate([_bits(byte, t) for t in range(8)])
        b = np.bincount(at, seen * ones, len(key))
        nodes.append({"depth": d, "key": key, "a": np.bincount(at, seen, len(key)) - b, "b": b})
    for x in reversed(nodes):
        a, b, below = x["a"].copy(), x["b"].copy(), np.zeros(len(x["key"]))
        if children is not None:
            at = np.searchsorted(x["key"], children[0])
            a[at] -= children[1]
            b[at] -= children[2]
            below[at] = children[3]
        own = log_kt(x["a"], x["b"])
        below += log_kt(a, b)
        x["kt"], x["rest"] = (x["b"] + 0.5) / (x["a"] + x["b"] + 1), (b + 0.5) / (a + b + 1)
        x["weight"] = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
        x["log"] = np.logaddexp(own, below) - math.log(2)
        children = sums_by_parent(x) if x["depth"] else None
    return nodes


def descend(nodes: list[dict], start: tuple | None = None) -> tuple[list, tuple | None]:
    """``(d, keys, probability of a 1)`` of the nodes, if each is the deepest
    that a decision reaches; and what the levels below start from: the keys of
    the last level, what the contexts so far add, and the share that is left."""
    tables = []
    for x in nodes:
        if start is None:
            base, share = np.zeros(len(x["key"])), np.ones(len(x["key"]))
        else:
            at = np.searchsorted(start[0], shorter(x["key"], x["depth"] - 1))
            base, share = start[1][at], start[2][at]
        one = base + share * (x["weight"] * x["kt"] + (1 - x["weight"]) * x["rest"])
        tables.append((x["depth"], x["key"], np.clip(one, 1e-12, 1 - 1e-12)))
        start = x["key"], base + share * x["weight"] * x["kt"], share * (1 - x["weight"])
    return tables, start


def log2_probability(gram: np.ndarray, tables: list) -> np.ndarray:
    """log2 probability of each gram's byte after its context; one half a bit where no level has a node."""
    total = np.zeros(len(gram))
    for t in range(8):
        node = _bit_nodes(gram >> np.uint64(8), gram & np.uint64(255), t)
        one, left = np.full(len(gram), 0.5), np.arange(len(gram))
        for d, keys, ones in reversed(tables):
            key = shorter(node[left], d)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            seen = keys[at] == key
            one[left[seen]] = ones[at[seen]]
            left = left[~seen]
        total += np.log2(np.where(_bits(gram & np.uint64(255), t) == 1, one, 1 - one))
    return total


# ---- the tree over Spark ------------------------------------------------------

def unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` with the largest ``n``, as many as fit in ``most``
    without telling near counts apart."""
    step, least, held = F.floor(F.log2("n") * 4), None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):
        held += r["rows"]
        if held > most:
            break
        least = r["step"]
    return counts.limit(0) if least is None else counts.where(step >= least)


COUNTED = "gram n key a b log"


def gram_probabilities(texts: DataFrame, text_col: str, train_col: str, depth: int = 6, least: int = 2) -> DataFrame:
    """``(gram, n, value)``: every distinct gram of all texts, how often the
    texts that teach (``train_col``) have it, and log2 of its probability in
    units of 1 / ``UNIT`` (an integer, so that sums are exact).

    Parts follow the number of texts, from 256 to 65536. Of the tree only what
    is above contexts of ``SPLIT`` bytes reaches the driver and is broadcast,
    at most 256 ** SPLIT rows.
    """
    if not 0 <= depth <= 6:
        raise ValueError("depth must be 0 to 6")
    bits = min(16, max(8, (texts.count() >> 10).bit_length()))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n = merge_grams(batches)
        yield from columns_of(COUNTED, gram=grams.view(np.int64), n=n)
        if levels := kept_levels(grams, n, SPLIT, depth, least):
            key, a, b, log = sums_by_parent(climb(levels)[0])
            yield from columns_of(COUNTED, key=key.view(np.int64), a=a.astype(np.int64), b=b.astype(np.int64), log=log)

    packed = texts.select(text_col, train_col).mapInArrow(lambda batches: count_grams(batches, depth, bits),
                                                          "part int, grams binary, n binary")
    found = saved(packed.groupBy("part").applyInArrow(merged, "gram long, n long, key long, a long, b long, log double"),
                  "byte-grams")
    counted = found.where("gram is not null").select("gram", "n")
    last = min(depth, SPLIT - 1)
    tops = (counted.groupBy(F.col("gram").bitwiseAND(F.lit(low_bits(8 * (last + 1)))).alias("gram"))
            .agg(F.sum("n").alias("n")).toArrow())
    # Exact decimal sums, so that they do not depend on the order of the parts.
    exact = F.sum(F.col("log").cast("decimal(30,6)")).cast("double")
    summed = (found.where("key is not null").groupBy("key")
              .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), exact.alias("log")).toArrow())
    children = (unsigned(summed["key"]), *[summed[c].to_numpy().astype(np.float64) for c in ("a", "b", "log")])
    levels = kept_levels(unsigned(tops["gram"]), tops["n"].to_numpy(), 0, last, least)
    shared = texts.sparkSession.sparkContext.broadcast(descend(climb(levels, children if summed.num_rows else None)))

    def valued(table: pa.Table) -> pa.Table:
        (tables, start), grams, n = shared.value, unsigned(table["gram"]), table["n"].to_numpy()
        if levels := kept_levels(grams, n, SPLIT, depth, least):
            tables = tables + descend(climb(levels), start)[0]
        value = np.rint(log2_probability(grams, tables) * UNIT).astype(np.int64)
        return pa.table({"gram": grams.view(np.int64), "n": n, "value": value})

    return saved(counted.withColumn("part", part_column(bits)).groupBy("part")
                 .applyInArrow(valued, "gram long, n long, value long"), "gram-values")


# ---- words ------------------------------------------------------------------

def count_words(batches, most: int = 400_000):
    """Arrow batches of texts to batches (word, n), summed within a task as far as ``most`` distinct words fit."""
    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                          ["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            held.update((text or b"").lower().split())
            if len(held) > most:
                yield out(held)
                held = Counter()
    yield out(held)


SCORE_FIELDS = {"n_tokens": pa.int64(), "known": pa.int64(), "logs": pa.float64(), "tail": pa.list_(pa.binary()),
                "grams": pa.list_(pa.int64()), "times": pa.list_(pa.int64()), "score": pa.float64()}


def _counted_by_text(own: np.ndarray, gram: np.ndarray, texts: int) -> tuple[list, list]:
    """Each text's distinct grams and how often it has them."""
    order = np.lexsort((gram, own))
    own, gram = own[order], gram[order]
    first = np.nonzero(np.r_[True, (own[1:] != own[:-1]) | (gram[1:] != gram[:-1])][:len(own)])[0]
    cuts = np.searchsorted(own[first], np.arange(1, texts))
    return np.split(gram[first].view(np.int64), cuts), np.split(np.diff(np.r_[first, len(own)]), cuts)


def _score_block(texts: list[bytes], depth: int, frequent: tuple, head) -> pa.StructArray:
    """Of each text: tokens, known head words and the sum of their logs, the
    other words, the grams that are not frequent, and the others' log2 probability."""
    split = [t.lower().split() for t in texts]
    known, logs, tails = [], [], []
    for own in split:
        values = list(map(head, own))
        found = [v for v in values if v is not None]
        known.append(len(found))
        logs.append(math.fsum(found))
        tails.append([w for w, v in zip(own, values) if v is None] if len(found) < len(own) else [])
    score, rare = np.zeros(len(split)), [(np.empty(0, np.int64), np.empty(0, np.uint64))]
    for own, gram in gram_windows([b" ".join(x) + b"\n" for x in split], depth):
        value, found = find(frequent, gram)
        score += np.bincount(own, value, len(split))
        rare.append((own[~found], gram[~found]))
    grams, times = _counted_by_text(*[np.concatenate(x) for x in zip(*rare)], len(split))
    columns = ([len(x) + 1 for x in split], known, logs, tails, grams, times, score)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, SCORE_FIELDS.values())],
                                      list(SCORE_FIELDS))


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = 6,
                    least: int = 2, head_grams: int = 1 << 21, head_words: int = 1 << 17) -> DataFrame:
    """One row per input row: ``id_col, n_tokens, n_known, train_tokens,
    base_score, score``; the model and the word counts are learned from the
    rows where ``train`` holds.

    Tokens are the words of the text lower-cased in A-Z, and one end. The base
    score adds log10((c + 1) / (N + V + 1)) over the tokens; ``score`` is the
    context tree's log10 probability of the words, a space between, and the
    end. A null, empty or blank text is its end alone. Without training rows
    every bit has probability one half. Rows that repeat are scored each.
    Other columns are not read.

    The ``head_grams`` most frequent grams and ``head_words`` most frequent
    words are broadcast; a document's others are joined with the full tables.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    taught = rows.where("train")
    grams = gram_probabilities(rows, "text", "train", depth, least)
    words = saved(taught.select("text").mapInArrow(count_words, "word binary, n long")
                  .groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    ends = taught.count()
    row = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = row[0] + ends, row[1] + (ends > 0)
    unit = math.log10(total + distinct + 1)
    head = {bytes(r["word"]): math.log10(r["n"] + 1) for r in most_frequent(words, head_words).toArrow().to_pylist()}
    known = most_frequent(grams.where("n > 0"), head_grams).select("gram", "value").toArrow()
    frequent = hash_table(unsigned(known["gram"]), known["value"].to_numpy() / UNIT)
    shared = spark.sparkContext.broadcast((head, frequent))

    def batch(texts: pa.Array) -> pa.Array:
        head, frequent = shared.value
        parts, block, size = [], [], 0
        for text in texts.cast(pa.binary()).to_pylist():
            block.append(text or b"")
            size += len(block[-1])
            if size > WINDOW:
                parts.append(_score_block(block, depth, frequent, head.get))
                block, size = [], 0
        if block:
            parts.append(_score_block(block, depth, frequent, head.get))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(SCORE_FIELDS.items())))

    kind = ("n_tokens long, known long, logs double, tail array<binary>, grams array<bigint>, times array<bigint>, "
            "score double")
    scored = saved(rows.select("id", arrow_udf(batch, kind)("text").alias("s"))
                   .select("id", "s.*", F.monotonically_increasing_id().alias("rid")), "scored")
    tail = (scored.select("rid", F.explode("tail").alias("word")).join(words, "word")
            .groupBy("rid").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs")))
    rare = scored.select("rid", F.explode(F.arrays_zip("grams", "times")).alias("g")).select(
        "rid", F.col("g.grams").alias("gram"), F.col("g.times").alias("times"))
    rare = rare.join(grams, "gram").groupBy("rid").agg((F.sum(F.col("times") * F.col("value")) / UNIT).alias("rare"))
    end_log, end_known = (math.log10(ends + 1), 1) if ends else (0.0, 0)
    return scored.join(tail, "rid", "left").join(rare, "rid", "left").select(
        F.col("id").alias(id_col), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + end_known).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + end_log - F.col("n_tokens") * unit).alias("base_score"),
        ((F.col("score") + F.coalesce("rare", F.lit(0.0))) * LOG10_2).alias("score"))
