"""Spelling variants: words that differ by one inserted, deleted or replaced letter.

Two words are near if common prefix plus common suffix reach the longer length
minus one. Pairs are compared densely: a block's words form padded matrices of
code points, one from the left and one from the right, cut into tiles, and
every pair of tiles of a block is compared at once.

Blocks are such that every near pair meets in exactly one, and none is large.
Of the longer length m, the edit lies in one of the regions of ``REGION``
letters; the words then agree before and after that region. A word of L letters
so belongs to a block for each region of m = L and of m = L + 1, named by a hash
of what is left around the region. The words of a block differ in at most
``REGION`` letters, so over the ``LETTERS`` letters of ``RUN`` it holds at most
90^2 + 90 words (but for chance collisions of hashes). A pair counts in the
region of its first difference.

Keys carry ids; only words that share a block are joined with their texts, so
a long word costs as many small rows as it has letters.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from journeykit.llm.storage import bounded_batches, saved

#: A run of letters; after A-Z are lower-cased it has LETTERS different ones.
RUN = "[A-Za-zÀ-ÿ]+"
LETTERS = 26 + 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REGION = 2
#: Rows of a tile, compared cells at a time, rows held before they are compared.
TILE = 64
CELLS = 1 << 22
HELD = 1 << 14
HELD_BYTES = 8 << 20
#: Odd factors of the hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# ---- words ------------------------------------------------------------------

def observed_words(docs: DataFrame, id_col: str, text_col: str, min_length: int, every: int | None) -> DataFrame:
    """One row per occurrence of a word: a run of letters, lower-cased in A-Z;
    if ``every`` divides h, the crc32 of ``<id>:<run>``, without its code point
    h % length."""
    text = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length)
    if every is None:
        return runs.select(F.col("run").alias("word"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shortened = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, shortened).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_length)


# ---- keys -------------------------------------------------------------------

def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words, one word after the other, and each word's number of them."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return codes, np.array([len(w) for w in words], np.int64)


def block_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """(index of the word, longer length m, region, hash of what is around the region)."""
    codes, length = code_points(words)
    start = np.cumsum(length) - length
    place = np.arange(len(codes)) - np.repeat(start, length)
    power = np.cumprod(np.full(int(length.max(initial=0)) + 1, FACTOR))
    letters = codes.astype(np.uint64) + np.uint64(1)
    zero = np.zeros(1, np.uint64)
    before = np.concatenate([zero, np.cumsum(letters * power[place])])
    after = np.concatenate([zero, np.cumsum(letters * power[np.repeat(length, length) - 1 - place])])
    out = []
    for more in (0, 1):
        regions = -(-(length + more) // REGION)
        own = np.repeat(np.arange(len(words)), regions)
        region = np.arange(len(own)) - np.repeat(np.cumsum(regions) - regions, regions)
        m, end = (length + more)[own], (start + length)[own]
        head = before[start[own] + REGION * region] - before[start[own]]
        tail = after[end] - after[end - np.maximum(m - REGION * (region + 1), 0)]
        key = (head ^ (head >> np.uint64(29))) * MIX[0] + (tail ^ (tail >> np.uint64(31))) * MIX[1]
        key += m.astype(np.uint64) * MIX[2] + region.astype(np.uint64) * MIX[3]
        out.append((own, m, region, key ^ (key >> np.uint64(32))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        at, size = 0, 0
        for i, word in enumerate(words):
            size += len(word)
            if size > HELD or i + 1 == len(words):
                own, m, region, key = block_keys(words[at:i + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(m.astype(np.int32)), pa.array(region.astype(np.int32)),
                     pa.array(ids[at:i + 1][own])], ["key", "m", "region", "id"])
                at, size = i + 1, 0


# ---- tiles ------------------------------------------------------------------

def padded(codes: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words from the left, and from the right backwards; 0 beyond the word."""
    place = np.arange(width)
    forward = np.zeros((len(length), width), np.uint32)
    forward[place < length[:, None]] = codes
    aligned = np.zeros((len(length), width), np.uint32)
    aligned[place >= width - length[:, None]] = codes
    return forward, aligned[:, ::-1]


def common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of all rows of each left tile with all of its right one."""
    same = (left[:, :, None, :] == right[:, None, :, :]) & (left != 0)[:, :, None, :]
    width = same.shape[-1]
    return np.where(same.all(-1), width, same.argmin(-1))


def tile_pairs(sizes: np.ndarray, tile: int) -> tuple[np.ndarray, ...]:
    """(first row, rows) of the left and right tile of every pair of tiles within a block."""
    starts = np.cumsum(sizes) - sizes
    out = []
    for n in np.unique(sizes):
        at = starts[sizes == n][:, None]
        cuts = np.arange(0, n, tile)
        i, j = np.triu_indices(len(cuts))
        rows = np.minimum(cuts + tile, n) - cuts
        shape = len(at), len(i)
        out.append([np.broadcast_to(x, shape).ravel()
                    for x in (at + cuts[i], rows[i][None, :], at + cuts[j], rows[j][None, :])])
    return tuple(np.concatenate(x) for x in zip(*out))


def near_in_blocks(words: list[str], sizes: np.ndarray, m: int, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are near, of blocks with longer length ``m``:
    ``sizes`` rows each, one block after the other, for the given regions."""
    codes, length = code_points(words)
    forward, backward = padded(codes, length, m)
    region = np.repeat(region, sizes)
    tile = max(1, min(TILE, int((CELLS / m) ** 0.5)))
    lefts, rights = [], []
    left, left_rows, right, right_rows = tile_pairs(sizes, tile)
    # Pairs of tiles of like size are stacked; rows beyond a tile are masked.
    side = 1 << np.ceil(np.log2(np.maximum(left_rows, right_rows))).astype(int)
    for s in np.unique(side):
        chosen = np.nonzero(side == s)[0]
        step = max(1, CELLS // (int(s) * int(s) * m))
        for at in range(0, len(chosen), step):
            some = chosen[at:at + step]
            offset = np.arange(s)
            i, j = (np.minimum(x[some][:, None] + offset, len(words) - 1) for x in (left, right))
            prefix = common(forward[i], forward[j])
            suffix = common(backward[i], backward[j])
            near = (prefix + suffix >= m - 1) & (i[:, :, None] < j[:, None, :])
            near &= np.maximum(length[i][:, :, None], length[j][:, None, :]) == m
            near &= prefix // REGION == region[i][:, :, None]
            near &= (offset < left_rows[some][:, None])[:, :, None] & (offset < right_rows[some][:, None])[:, None, :]
            p, a, b = np.nonzero(near)
            lefts.append(i[p, a])
            rights.append(j[p, b])
    return np.concatenate(lefts), np.concatenate(rights)


PAIR = {"id": pa.int64(), "near_id": pa.int64(), "near_word": pa.string(), "near_n": pa.int64()}


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, m, region, id, word, n) in order of key, m, region to near pairs, both ways."""
    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = [table[c].to_numpy() for c in ("key", "m", "region")]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in names], axis=0)
        first = np.nonzero(new)[0]
        sizes = np.diff(np.append(first, table.num_rows))
        for m in np.unique(names[1]):
            blocks = (names[1][first] == m) & (sizes > 1)
            rows = np.nonzero(np.repeat(blocks, sizes))[0]
            if not len(rows):
                continue
            own = table.take(pa.array(rows))
            a, b = near_in_blocks(own["word"].to_pylist(), sizes[blocks], int(m), names[2][first][blocks])
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            for at in range(0, len(a), HELD):
                mine, other = own["id"].take(pa.array(a[at:at + HELD])), own.take(pa.array(b[at:at + HELD]))
                yield from pa.table({"id": mine, "near_id": other["id"], "near_word": other["word"],
                                     "near_n": other["n"]}).cast(pa.schema(PAIR)).combine_chunks().to_batches()

    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < HELD and size < HELD_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        # The last block may go on in the next batch.
        changed = np.zeros(table.num_rows - 1, bool)
        for c in ("key", "m", "region"):
            x = table[c].to_numpy()
            changed |= x[1:] != x[:-1]
        last = np.nonzero(changed)[0]
        open_at = int(last[-1]) + 1 if len(last) else 0
        if open_at:
            yield from compared(table.slice(0, open_at).combine_chunks())
        held = table.slice(open_at).combine_chunks().to_batches()
        rows, size = table.num_rows - open_at, 0
    if rows:
        yield from compared(pa.Table.from_batches(held).combine_chunks())


def near_words(words: DataFrame) -> DataFrame:
    """``id, near_id, near_word, near_n`` of all near pairs, both ways once, of
    ``words`` (distinct ``word``, with ``id`` and ``n``)."""
    keys = words.select("id", "word").mapInArrow(_keys, "key long, m int, region int, id long")
    block = ["key", "m", "region"]
    shared = (keys.withColumn("words", F.count(F.lit(1)).over(Window.partitionBy(*block)))
              .where(F.col("words") > 1).drop("words"))
    rows = shared.join(words, "id").select(*block, "id", "word", "n")
    rows = rows.repartition(*block).sortWithinPartitions(*block, "id")
    return rows.mapInArrow(_near, "id long, near_id long, near_word string, near_n long")


# ---- forms ------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """``id, root_id`` of every row of ``forms`` (id, form_id): the end of its
    chain of forms. Each round doubles the steps that are taken at once; a form
    is at least ``ratio`` times as frequent as its word, so chains have at most
    a few dozen steps and there are a few rounds."""
    reach = saved(forms.select("id", F.col("form_id").alias("root_id")), "roots")
    while True:
        ahead = reach.select(F.col("id").alias("root_id"), F.col("root_id").alias("beyond"))
        step = saved(reach.join(ahead, "root_id", "left")
                     .select("id", F.coalesce("beyond", "root_id").alias("root_id"), F.col("beyond").isNotNull().alias("moved")),
                     "roots")
        reach = step.select("id", "root_id")
        if not step.where("moved").limit(1).count():
            return reach


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
                      min_count: int = 3, ratio: int = 2, every: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of at least
    ``min_length`` letters and ``min_count`` occurrences in all texts.

    A word's form is its near word of largest n (ties: smallest in code-point
    order) if that is at least ``ratio`` times its own n, else null; its root is
    the last of the chain of forms, itself without a form. ``every`` deletes
    letters as ``observed_words`` states.

    Null and empty texts have no words; a null id counts as the empty text.
    Texts and words of any length are taken whole. Rows that repeat count
    each. No words give no rows. Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("chains of forms end only if a form is more frequent than its word: ratio must be 2 or more")
    bounded_batches(docs.sparkSession)
    counted = (observed_words(docs, id_col, text_col, min_length, every)
               .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))
    words = saved(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    first = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near_word").alias("form"),
                           F.col("near_id").alias("form_id"), F.col("near_n").alias("form_n")))
    nearest = near_words(words).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), first.alias("best"))
    rows = saved(words.join(nearest, "id", "left").select("id", "word", "n", "n_near", "best.form", "best.form_id", "best.form_n"),
                 "nearest")
    has_form: Column = F.col("form_n") >= ratio * F.col("n")
    ends = roots(rows.where(has_form).select("id", "form_id"))
    named = ends.join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").drop("root_id")
    return rows.join(named, "id", "left").select(
        "word", F.when(has_form, F.col("form")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has_form, F.col("form_n")).alias("form_n"))
