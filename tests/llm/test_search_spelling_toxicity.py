"""Lexical search, spelling variants and toxicity against brute force and
held-out labels, with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing column names."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from journeykit.llm import lexical_search, spelling, toxicity
from journeykit.llm.queries import LLM_QUERIES

SF_SMALL, SF_MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
UPPER = {c: c + 32 for c in range(65, 91)}


# ---- lexical search -----------------------------------------------------------

def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def _ranked(docs, items, k=10):
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 25 + (75 * bag.total() * n_docs) // total if bag else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in _terms(text) if t in bag)
            if score > 0:
                scores.append((-score, math.inf if i is None else i))
        out += [(item, rank, None if i == math.inf else i, -score) for rank, (score, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _found(docs, items, k=10):
    return sorted(map(tuple, lexical_search.search(docs, items, k).collect()), key=str)


SEARCHED = [(1, None), (2, ""), (3, " -- !"), (4, "Cat cat dog_bird 日本語 naïve"), (5, "cat " * 40 + "dog"), (5, "cat " * 40 + "dog"),
            (6, "x" * 3_000_000 + " dog"), (None, "cat dog"), (None, "bird"), (9, "CAT DOG"), (8, "cat dog"), (7, "dog cat")]
SEARCHED += [(100 + i, "cat dog") for i in range(40)] + [(200 + i, f"w{i % 3} w{i % 4} filler" + " more" * (i % 5)) for i in range(60)]
ITEMS = [(1, "cat cat dog"), (2, "naïve w1 w2 w2"), (3, None), (4, "?!"), (4, "日本語"), (5, "nowhere"), (6, "x" * 3_000_000), (7, "Dog")]


@pytest.mark.parametrize("cells,k", [(1 << 23, 10), (12, 10), (1 << 23, 3)])
def test_search_brute_force(spark, monkeypatch, cells, k):
    """Ties, null ids, classes of more members than k; also in blocks of an item or two, and small matrices."""
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in SEARCHED], "doc_id long, text string, id int, bag int, score int")
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, rank int")
    assert _found(docs.repartition(7), items, k) == _ranked(SEARCHED, ITEMS, k)


def test_search_empty(spark):
    docs, items = spark.createDataFrame(SEARCHED, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert _found(docs.limit(0), items) == _found(docs, items.limit(0)) == _found(docs.where("text is null"), items) == []


def test_search_windows(monkeypatch):
    monkeypatch.setattr(lexical_search, "WINDOW", 5)
    text = "Ab c-dé, fgh ijklmnop q"
    assert [t.decode() for w in lexical_search.term_windows(text.encode()) for t in w] == _terms(text)


def test_class_scores_beyond_doubles():
    rng = np.random.default_rng(2)
    bags = [np.array([np.arange(6), rng.integers(1, 9, 6)]) for _ in range(5)]
    weights, items, m = np.full(6, 40_000), rng.integers(0, 10**6, (6, 3)), np.full(5, 30)
    got = lexical_search.class_scores(bags, m, weights, items)
    for i, bag in enumerate(bags):
        for q in range(3):
            assert int(got[i, q]) == sum(40_000 * (10**9 * int(tf) // (1000 * int(tf) + 240)) * int(items[t, q]) for t, tf in bag.T)


# ---- spelling variants --------------------------------------------------------

def _edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1:]
            yield from (word[:i] + c + word[i + 1:] for c in letters)


def _words(docs, every=97, least=5):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += len(run) >= least
    return {w: n for w, n in seen.items() if n >= 3}


def _variants(words):
    letters = sorted({c for w in words for c in w})
    near = {w: {e for e in _edits(w, letters) if e in words and e != w} for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w)))
    return out


def test_spelling_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = _variants(_words(docs))
    got = LLM_QUERIES["op12_spelling_variants"](spark, SF_SMALL).collect()
    assert len(got) == len(want) > 1000 and any(r["form"] and r["root"] != r["form"] for r in got)
    assert {r["word"]: tuple(r) for r in got} == want


def test_spelling_brute_force(spark, monkeypatch):
    """Blocks of more than a tile, chunks that cut blocks, long words, ties, a null id, repeated rows."""
    monkeypatch.setattr(spelling, "HELD", 100)
    monkeypatch.setattr(spelling, "TILE", 8)
    rng = np.random.default_rng(4)
    words = ["aaaaa", "aaaa", "aaaaaa", "aaaaab", "baaaaa", "abaaaa", "Äaaaa", "äaaaa", "q" * 3000, "q" * 2999, "q" * 2999 + "z"]
    words += ["prefix" + a + b for a in "abcdefghij" for b in "abcdefghij"]
    words += ["".join(rng.choice(list("xyz"), 6)) for _ in range(200)]
    rows = [(i if i % 9 else None, " ".join(words[j] + "," for j in rng.integers(0, len(words), 150)), "x", 1) for i in range(60)]
    rows += [rows[0], (77, None, "x", 1), (78, "", "x", 1), (79, " 12 _ ", "x", 1), (80, "×÷abc " * 4, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    for every in (None, 7):
        want = _variants(_words([r[:2] for r in rows], every))
        got = spelling.spelling_variants(docs, every=every).collect()
        assert {r["word"]: tuple(r) for r in got} == want and len(got) == len(want)
    assert max(len(w) for w in want) == 3000
    assert spelling.spelling_variants(docs.limit(0)).count() == 0 == spelling.spelling_variants(docs.where("text is null")).count()


def test_block_keys_meet_once():
    """A near pair shares exactly one block for the region of its first difference, whatever the edit."""
    for a, b in [("abcde", "abXde"), ("abcde", "abcd"), ("abcd", "xabcd"), ("aaaaa", "aaaa"), ("abcdefg", "abcdefX")]:
        own, m, region, key = spelling.block_keys([a, b])
        at = [{k: r for o, lm, r, k in zip(own, m, region, key) if o == i and lm == max(len(a), len(b))} for i in (0, 1)]
        prefix = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix // spelling.REGION in [r for k, r in at[0].items() if k in at[1]]


# ---- toxicity -----------------------------------------------------------------

CLEAN = "river stone garden window table bread winter morning paper letter music".split()
RUDE = ["idiot", "worthless", "pathetic"]


def _text(rng, rude, words=60):
    own = [str(w) for w in rng.choice(CLEAN, words)]
    own = [w + str(rng.choice(list("bdklmr"))) + "e" for w in own]
    for _ in range(rude):
        own[int(rng.integers(words))] = str(rng.choice(RUDE))
    return " ".join(own)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows = [(i, _text(rng, 2 * (i % 4 == 0)), "junk", i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(r[0], int(r[3]), 0) for r in rows] + [(3, None, 0), (None, 1, 0)],
                                   "doc_id long, toxic int, text int")
    return docs, labels


def test_unseen_misspellings(spark, labelled):
    """A misspelt word that no training text has still tells; clean texts stay clean; copies and order change nothing."""
    docs, labels = labelled
    model = toxicity.learn(docs, labels, F.col("doc_id") < 300)
    again = toxicity.learn(docs.repartition(5), labels, F.col("doc_id") < 300)
    assert (model["logits"] == again["logits"]).all() and model["bias"] == again["bias"]
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score(F.col("text"), model, spark).alias("s")).collect()}
    held = [(got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)]
    assert np.mean(held) >= 0.95
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(40):
        words = _text(rng, 0).split()
        texts += [" ".join(words), " ".join([*words[:30], "idiott", *words[30:], "worthles", "Patheticc!"])]
    s = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        toxicity.score(F.col("t"), model, spark).alias("s")).collect()]
    assert np.mean(np.array(s[0::2]) < 0.5) >= 0.95 and np.mean(np.array(s[1::2]) >= 0.5) >= 0.95


def test_toxicity_odd(spark, labelled):
    docs, labels = labelled
    model = toxicity.learn(docs, labels, F.col("doc_id") < 200, bits=16)
    odd = [None, "", " \n ", "?!", "idiot " * 300_000, "idiot", "x" * 3_000_000, "naïve 日本語", "idiot"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string").repartition(1)
    s = [r["s"] for r in rows.select("text", toxicity.score(F.col("text"), model, spark).alias("s")).collect()]
    by_text = {r["text"]: r["s"] for r in rows.select("text", toxicity.score(F.col("text"), model, spark).alias("s")).collect()}
    assert all(0 <= x <= 1 for x in s) and len(s) == len(odd)
    assert by_text[None] == by_text[""] == by_text["?!"] == pytest.approx(1 / (1 + math.exp(-model["bias"])))
    assert by_text["idiot"] == pytest.approx(by_text["idiot " * 300_000], abs=1e-9) and by_text["idiot"] > 0.5
    for none in (toxicity.learn(docs.limit(0), labels, F.lit(True), bits=12), toxicity.learn(docs, labels.limit(0), F.lit(True), bits=12),
                 toxicity.learn(docs, labels.where("toxic = 0"), F.lit(True), bits=12)):
        assert not none["logits"].any()
    assert docs.limit(0).select(toxicity.score(F.col("text"), model, spark)).count() == 0


def test_toxicity_sample_is_bounded(spark, labelled):
    """Copies enter the sample once, and it holds no more than ``max_docs`` texts."""
    docs, labels = labelled
    hot = docs.unionByName(spark.range(1000, 1300).select(F.col("id").alias("doc_id"), F.lit("one text for all").alias("text"),
                                                          F.lit("x").alias("label")))
    more = labels.unionByName(spark.range(1000, 1300).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"), F.lit(0).alias("text")))
    seen = []
    train = toxicity.train
    try:
        toxicity.train = lambda texts, weights, y: seen.append(len(texts)) or train(texts, weights, y)
        toxicity.learn(hot, more, F.lit(True), bits=14, max_docs=150)
        toxicity.learn(hot, more, F.lit(True), bits=14)
    finally:
        toxicity.train = train
    assert seen == [150, 401]


@pytest.mark.parametrize("words", [["idiot"], ["a", "bc", "def", "é" * 9], ["x" * 50, "idiot", "idiots"]])
def test_word_grams(words):
    own, bucket = toxicity.word_grams(words, 20)
    for i, w in enumerate(words):
        marked = f"<{w}>"
        assert (own == i).sum() == sum(max(len(marked) - n + 1, 0) for n in toxicity.GRAMS) + 1
    again = toxicity.word_grams([*words, "other"], 20)
    assert sorted(bucket) == sorted(again[1][again[0] < len(words)])


def test_word_blocks(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 10)
    text = "(One) two, three " + "x" * 33 + " four"
    got = [w for words in toxicity.words_of(text) for w in words]
    assert "".join(got) == "onetwothree" + "x" * 33 + "four" and got[:3] == ["one", "two", "three"]


def test_toxicity_query(spark):
    """The registered query: columns, held-out rows, and the rude words of the labelled texts found in held-out ones."""
    rows = LLM_QUERIES["op11_toxicity"](spark, SF_MIDDLE).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_MIDDLE}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    rude = re.compile("trash|pathetic|idiot|disgusting|worthless|clown|stupid|loser|scum|moron", re.I)
    toxic = [r["predicted"] for r in rows if r["held_out"] and len(rude.findall(docs[r["doc_id"]])) > 1]
    clean = [r["predicted"] for r in rows if r["held_out"] and not rude.search(docs[r["doc_id"]])]
    assert len(toxic) >= 5 and np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.08


def test_equal_texts_score_alike():
    logits = np.random.default_rng(0).integers(-10**6, 10**6, 1 << 12)
    words = toxicity.WordLogits(12, logits)
    a, b = "one two three two", "three one two two"
    got = words.margins([a, "filler " * 1000, a, b, None])
    assert got[0] == got[2] == got[3] and got[4] == 0.0
    own, bucket = toxicity.word_grams(a.split(), 12)
    assert got[0] == pytest.approx(logits[bucket].mean() / toxicity.UNIT)


def test_tiles_cover_all_pairs():
    sizes = np.array([2, 5, 17, 8, 1])
    left, rows_l, right, rows_r = spelling.tile_pairs(sizes, 4)
    got = {(i, j) for a, n, b, m in zip(left, rows_l, right, rows_r) for i in range(a, a + n) for j in range(b, b + m) if i < j}
    starts = np.cumsum(sizes) - sizes
    assert got == {(s + i, s + j) for s, n in zip(starts, sizes) for i in range(n) for j in range(i + 1, n)}


def test_pair_schema():
    assert [f.name for f in pa.schema(spelling.PAIR)] == ["id", "near_id", "near_word", "near_n"]
