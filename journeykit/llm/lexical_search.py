"""Ranked lexical search over all documents, each class of equal bags scored once.

Documents are restricted to the vocabulary of the items: what is left of one is
its bag, the terms' indices and frequencies. Documents with the same bag and
the same length factor m have the same score for every item; they are put into
one class by a hash, verified by the bag and m themselves, and the class is
scored once. Scoring multiplies a block of classes (term impacts, a dense
matrix over the terms the block holds) by the items' term counts. The best
classes are expanded to their members by ascending id.

Only the ``k`` smallest ids of a class can be among an item's ``k`` best, and
only the ``k`` best classes by (score, smallest id); so a class of any size,
and any number of equal scores, stay bounded and nothing is lost.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from journeykit.llm.storage import bounded_batches, saved

#: ASCII letters in lower case and digits stay, all bytes of other characters too; other ASCII separates terms.
KEPT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Bytes of a text that are cut into terms at a time.
WINDOW = 1 << 20
#: Cells of a matrix of items by terms, and of one of classes by terms.
CELLS = 1 << 23
CLASS_ROWS = 256
NO_ID = np.iinfo(np.int64).max


def term_windows(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a window of it at a time; a term is never cut."""
    data = (text or b"").translate(KEPT)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + WINDOW)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_terms(text: bytes | None, wanted) -> tuple[int, Counter]:
    """Number of terms, and how often the text has each term that ``wanted`` maps to a key."""
    n, found = 0, Counter()
    for terms in term_windows(text):
        n += len(terms)
        found.update(map(wanted, terms))
    found.pop(None, None)
    return n, found


class ItemBlock:
    """Items that are searched together: their ids, and how often each has each term of the block."""

    def __init__(self):
        self.ids, self.counts, self.vocabulary = [], [], {}

    def add(self, item_id, found: Counter) -> None:
        self.ids.append(item_id)
        self.counts.append({self.vocabulary.setdefault(t, len(self.vocabulary)): n for t, n in found.items()})

    def full_with(self, found: Counter) -> bool:
        """Whether the items by terms would be above the bound (an item of its own always fits)."""
        return bool(self.ids) and (len(self.ids) + 1) * (len(self.vocabulary) + len(found)) > CELLS

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.vocabulary), len(self.ids)), np.int64)
        for i, counts in enumerate(self.counts):
            out[list(counts), i] = list(counts.values())
        return out


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[ItemBlock]:
    """The items in blocks of bounded size; those without a term are left out. An item is held whole, one at a time."""
    block = ItemBlock()
    for row in items.select(item_col, F.col(text_col).cast("binary")).toLocalIterator():
        _, found = count_terms(None if row[1] is None else bytes(row[1]), lambda term: term)
        if not found:
            continue
        if block.full_with(found):
            yield block
            block = ItemBlock()
        block.add(row[0], found)
    if block.ids:
        yield block


def pack_bag(found: Counter) -> bytes:
    """Term indices in ascending order, then their frequencies."""
    terms = sorted(found)
    return np.array([terms, [found[t] for t in terms]], "<i4").tobytes()


def unpack_bag(bag: bytes) -> np.ndarray:
    return np.frombuffer(bag, "<i4").reshape(2, -1)


def _bags(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            counted = [count_terms(t, get) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in counted], pa.int64()),
                 pa.array([pack_bag(found) for _, found in counted], pa.binary())], ["id", "n", "bag"])
    return run


def _document_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            held = [unpack_bag(b)[0] for b in batch.column(0).to_pylist()]
            df += np.bincount(np.concatenate(held) if held else [], minlength=size)
        term = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df[term])], ["term", "df"])
    return run


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def class_scores(bags: list[np.ndarray], m: np.ndarray, weights: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Scores of a block of classes (rows) for all items (columns), exact 64-bit integers."""
    own = np.repeat(np.arange(len(bags)), [b.shape[1] for b in bags])
    term, tf = np.concatenate(bags, axis=1).astype(np.int64)
    impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[own]))
    terms, at = np.unique(term, return_inverse=True)
    block = np.zeros((len(bags), len(terms)), np.int64)
    block[own, at] = impact
    items = items[terms]
    # Doubles multiply faster, and are exact while every sum stays below 2 ** 53.
    if float(impact.max(initial=0)) * float(items.sum(axis=0).max(initial=0)) < 2 ** 53:
        return np.rint(block.astype(np.float64) @ items.astype(np.float64)).astype(np.int64)
    return block @ items


def _row_blocks(bags: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose dense matrix stays within the bound, whatever their terms."""
    at, width = 0, 0
    for i, bag in enumerate(bags):
        if i > at and (i - at == CLASS_ROWS or (i + 1 - at) * (width + bag.shape[1]) > CELLS):
            yield at, i
            at, width = i, 0
        width += bag.shape[1]
    if bags:
        yield at, len(bags)


def _best(item: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Indices of each item's ``k`` best rows: highest score, then smallest first id."""
    order = np.lexsort((first, -score, item))
    start = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - start < k]


def _candidates(shared, k: int):
    """Classes (m, bag, first, ids) of a partition to each item's best of them: (item, score, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = shared.value
        held_item, held_score, held_first = (np.empty(0, np.int64) for _ in range(3))
        held_ids: list = []
        least = np.ones(items.shape[1], np.int64)      # an item's k-th best score so far, 1 at least
        for batch in batches:
            bags = [unpack_bag(b) for b in batch.column("bag").to_pylist()]
            m = batch.column("m").to_numpy()
            first = batch.column("first").fill_null(NO_ID).to_numpy()
            ids = batch.column("ids")
            for lo, hi in _row_blocks(bags):
                scores = class_scores(bags[lo:hi], m[lo:hi], weights, items)
                at, item = np.nonzero(scores >= least)
                if not len(at):
                    continue
                item = np.concatenate([held_item, item])
                score = np.concatenate([held_score, scores[at, item[len(held_item):]]])
                new_first = np.concatenate([held_first, first[lo + at]])
                kept = _best(item, score, new_first, k)
                old = len(held_item)
                held_ids = [held_ids[i] if i < old else ids[int(lo + at[i - old])].as_py() for i in kept]
                held_item, held_score, held_first = item[kept], score[kept], new_first[kept]
                own, count = np.unique(held_item, return_counts=True)
                full = own[count == k]
                least[full] = held_score[np.searchsorted(held_item, full, "right") - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held_item), pa.array(held_score), pa.array(held_ids, pa.list_(pa.struct([("id", pa.int64())])))],
            ["item", "score", "ids"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_col, rank, id_col, score``: each item's ``k`` highest-scoring
    documents with a score above 0, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of all other characters,
    lower-cased in A-Z. With N documents that have a term, L terms in all, n
    in a document, and df, tf of a term, its weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), the document's m is
    25 + (75 n N) div L, and the score sums over the item's terms, repeats
    included, weight * ((10^9 tf) div (1000 tf + 8 m)).

    ``id_col`` is an integer. Null and empty texts have no term: they are
    never found, and such an item has no row. A null id comes after all others.
    Rows that repeat are documents, and items, each; equal scores of rows
    equal in id have any order. Texts of any length are read whole, a window at
    a time. Without documents or items there are no rows. Other columns of
    either table are not read.

    Items are searched in blocks whose matrix of terms by items is bounded
    (``CELLS``) and broadcast; a block reads the documents once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = dict(items.dtypes)[item_col]
    results = None
    for block in item_blocks(items, item_col, item_text_col):
        found = _search_block(texts, block, k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, `{item_col}` {kind}")
        out = found.join(F.broadcast(names), "item").select(
            f"`{item_col}`", "rank", F.col("id").alias(id_col), "score")
        results = out if results is None else results.unionByName(out)
    if results is None:
        return spark.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` bigint, score bigint")
    return results


def _search_block(texts: DataFrame, block: ItemBlock, k: int) -> DataFrame:
    spark = texts.sparkSession
    context = spark.sparkContext
    vocabulary = context.broadcast(block.vocabulary)
    bags = saved(texts.mapInArrow(_bags(vocabulary), "id long, n long, bag binary"), "bags")
    n_docs, n_terms = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    counted = (bags.where("octet_length(bag) > 0").select("bag")
               .mapInArrow(_document_frequencies(len(df)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")))
    for row in counted.collect():                      # at most a row per term of the block
        df[row["term"]] = row["df"]
    # The product may pass 64 bits on its way.
    m = F.expr(f"25 + cast(cast(75 * n as decimal(20,0)) * {n_docs} div {max(n_terms, 1)} as bigint)")
    rows = bags.where("octet_length(bag) > 0").select("id", "bag", m.alias("m"))
    rows = rows.withColumn("hash", F.xxhash64("bag", "m"))
    same = ["hash", "m", "bag"]
    smallest = Window.partitionBy(*same).orderBy(F.asc_nulls_last("id"))
    classes = (rows.withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k)
               .groupBy(*same).agg(F.min("id").alias("first"), F.collect_list(F.struct("id")).alias("ids")))
    scoring = context.broadcast((term_weights(df, n_docs), block.matrix()))
    best = classes.select("m", "bag", "first", "ids").mapInArrow(
        _candidates(scoring, k), "item long, score long, ids array<struct<id: long>>")
    members = best.select("item", "score", F.explode("ids").alias("member")).select("item", "score", "member.id")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
