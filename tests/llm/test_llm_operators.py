"""The dealt operators against brute force, exact round trips, held-out
accuracy and DuckDB, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing column names."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline

from journeykit.llm import arc_warc, ctw, embedding_dedup, langid, line_dedup, mixing, order_minhash, sharding, simhash, sp_bpe
from journeykit.llm.components import connected_components
from journeykit.llm.queries import LLM_ORACLE_SQL, LLM_QUERIES
from oracle_compare import compare, duck_connect

SF_SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = {"en": "the cat sat on the mat and then the dog ran over the hill with the cat ",
         "de": "der hund und die katze sind nicht auf der straße sondern in dem haus "}
ODD = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "word " * 30000, "en", "b", 1),
       (4, "word " * 30000, "en", "b", 1), (None, "no id at all here", "de", "b", 1), (7, "123 ... !!", "de", None, 1),
       (8, "naïve café 日本語 \u0085 x \x1c y", "en", "b", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def _groups(n, linked):
    root = list(range(n))
    for _ in range(n):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("key", sorted(LLM_ORACLE_SQL))
def test_sql(spark, key):
    got = compare(LLM_QUERIES[key](spark, SF_SMALL), duck_connect(SF_SMALL), LLM_ORACLE_SQL[key])
    assert got["hash_match"], got


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 160)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _groups(161, links)
    assert all(got.get(i, i) == want[i] for i in range(161))


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 12))
    vectors = [(base[i % 8] + rng.normal(size=12) * 0.06).astype(np.float32).tolist() for i in range(90)]
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)] + [(90 + i, vectors[i], i % 2) for i in range(6)]
    odd = [(200, None, 1), (201, [0.0] * 12, 1), (202, [float("nan")] * 12, 1), (203, [None] + [1.0] * 11, 1),
           (204, [float("inf")] * 12, 1), (205, vectors[0], None), (206, [1.0, 2.0], 1), (207, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_near_duplicates(df, tile_rows=16).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    cosine = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    linked = [(i, j) for i in range(96) for j in range(96) if i != j and rows[i][2] == rows[j][2] and cosine[i, j] >= 0.98]
    part = _groups(96, linked)
    assert len(linked) > 100
    for i in range(96):
        want = (sum(a == i for a, _ in linked), part[i], part[i] == i)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == want
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(200, 208))
    assert embedding_dedup.embedding_near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(7)
    unit = rng.normal(size=(200, 48))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    coded = embedding_dedup.quantise(unit)
    pairs = {(a, b) for i, j in embedding_dedup.candidate_pairs(coded, coded, 0.2) for a, b in zip(i, j)}
    assert {tuple(p) for p in np.argwhere(unit @ unit.T >= 0.2)} <= pairs
    assert len(pairs) < 1.2 * (unit @ unit.T >= 0.2).sum()


def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)][:len(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_brute_force(spark, odd):
    got = simhash.simhash_components(odd).collect()
    want = {i: f"{_print(t):016x}" for i, t, *_ in ODD}
    assert len(got) == len(ODD) and all(r["fingerprint"] == want[r["doc_id"]] for r in got)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 7, 8]
    assert simhash.simhash_dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_rows", [1, 32])
def test_pigeonring_finds_all(spark, bucket_rows):
    rng = np.random.default_rng(11)
    bases = rng.integers(0, 1 << 62, 12)
    prints = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 4), replace=False)) for b in bases for _ in range(25)]
    prints = sorted({simhash.signed(p | (1 << 63 if i % 3 == 0 else 0)) for i, p in enumerate(prints)})
    linked = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & simhash.FULL).bit_count() <= 2]
    want = _groups(len(prints), linked)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["fp"]: r["part"] for r in simhash.fingerprint_components(df, bucket_rows=bucket_rows, tile_rows=8).collect()}
    assert all(got[prints[i]] == prints[want[i]] for i in range(len(prints)))


def test_language(spark, odd):
    rows = [(i, PROSE[k] * (1 + i % 5), k, "s", 1) for i in range(60) for k in PROSE]
    docs = spark.createDataFrame(rows + ODD, DOCS)
    filters = langid.learn_filters(docs, train=F.col("source") == "s")
    told = {r["doc_id"]: r for r in langid.identify_language(
        odd.withColumn("score", F.lit("clash")), filters).collect()}
    assert told[1]["lang_pred"] == told[2]["lang_pred"] == told[7]["lang_pred"] == "und" and told[7]["score"] == 0
    test = spark.createDataFrame([(1, "the dog sat on the hill"), (2, "die katze und der hund")], "i int, text string")
    assert {r["i"]: r["lang_pred"] for r in langid.identify_language(test, filters).collect()} == {1: "en", 2: "de"}
    none = langid.learn_filters(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify_language(test, none).collect()} == {"und"}
    real = LLM_QUERIES["op3_language_id"](spark, SF_SMALL).join(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in real]) > 0.97


def test_language_sample_of_distinct_texts(spark, monkeypatch):
    """A hot copy is read once, within the bound, and does not crowd out the n-grams of the other texts."""
    words = ["".join(chr(97 + (7 * i + 11 * j + i * j) % 26) for j in range(6)) for i in range(200)]
    hot = "zzyzx qqvqq " * 40
    rows = [(f"{w} {v}", "en") for w in words[:20] for v in words[:20]] + [(hot, "en")] * 400
    docs = spark.createDataFrame(rows, "text string, lang string")
    asked = spark.createDataFrame([(" ".join(words[:20]),)], "text string")
    seen = []
    for docs in (docs, docs.distinct()):
        filters = langid.learn_filters(docs, min_rate=2e-3)
        seen.append((filters.slots.tolist(), langid.identify_language(asked, filters).first()["score"]))
    assert seen[0] == seen[1] and seen[0][1] > 0.5
    # All hashes of a language's sample are below the share: with half the rows copies, the share is of distinct texts.
    read = spark.sparkContext.accumulator(0)
    count = langid.count_ngrams

    def counted(batches, orders):
        held = list(batches)
        read.add(sum(b.num_rows for b in held))
        return count(held, orders)

    monkeypatch.setattr(langid, "count_ngrams", counted)
    langid.learn_filters(spark.createDataFrame(rows + [(f"{w} x", "en") for w in words] * 3, "text string, lang string"), max_docs=100)
    assert 0 < read.value <= 150


def test_many_languages(spark):
    rng = np.random.default_rng(2)
    words = {f"l{i:02d}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(20)] for i in range(70)}
    train = spark.createDataFrame([(" ".join(w * 3), k) for k, w in words.items()], "text string, lang string")
    filters = langid.learn_filters(train, min_rate=1e-4)
    asked = spark.createDataFrame([(" ".join(w[:8]), k) for k, w in words.items()], "text string, want string")
    assert all(r["lang_pred"] == r["want"] for r in langid.identify_language(asked, filters).collect())


def test_lines_odd(spark, odd):
    rows = [(10 + i, f"menu\nown {i}\n\nmenu", "en", None if i % 2 else "x", 1) for i in range(8)]
    docs = odd.unionByName(spark.createDataFrame(rows, DOCS)).withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate_lines(docs, max_ratio=0.5).collect()}
    assert all(got[10 + i]["text"] == f"own {i}\n" and got[10 + i]["n_dropped"] == 2 for i in range(8))
    assert got[1]["text"] is None and got[2]["text"] == "" and got[3]["text"] == " \n\t "
    # a copied page does not become boilerplate
    copies = spark.createDataFrame([(i, "alpha\nbeta", "en", "y", 1) for i in range(9)], DOCS)
    assert {r["text"] for r in line_dedup.drop_boilerplate_lines(copies).collect()} == {"alpha\nbeta"}
    assert line_dedup.drop_boilerplate_lines(docs.limit(0)).count() == 0


def test_lines_of_one_page_in_fifty(spark):
    """A line on 2 % of a site's pages is boilerplate, to the operator and to the pipeline; one on two pages is not."""
    rows = [(i, f"own {i}\n" + ("advert" if i % 50 == 0 else "chance" if i in (1, 2) else f"more {i}"), "en", "x", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    stage = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SF_SMALL)
    for out in (line_dedup.drop_boilerplate_lines(docs), stage):
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(got[i] == (f"own {i}" if i % 50 == 0 else t) for i, t, *_ in rows)


def _tuples(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return {r["i"]: r["fp"] for r in order_minhash.add_fingerprint(df, "text", "fp").collect()}


def test_order_minhash(spark):
    words = [f"w{i}" for i in range(300)]
    swapped = words[150:] + words[:150]
    texts = [" ".join(words), " ".join(words), " ".join(words[:200] + ["z"] + words[200:]), " ".join(reversed(words)),
             " ".join(swapped), None, "", "one", "a b c", "x y " * 40, "x y " * 41]
    got = _tuples(spark, texts)
    near = lambda a, b: len(set(got[a]) & set(got[b])) / max(len(set(got[a])), len(set(got[b])), 1)
    assert got[0] == got[1] and len(got[0]) == 64
    assert near(0, 2) > 0.8 and near(0, 3) == 0
    assert got[5] == got[6] == [] and len(got[7]) == 1 and len(got[8]) == 1
    assert got[9] != got[10]  # occurrences are numbered


def test_order_minhash_unspaced(spark):
    """An edit in a text without spaces leaves the k-mers it does not touch, beyond the BMP as well."""
    rng = np.random.default_rng(9)
    for first in (0x4E00, 0x20000):
        text = "".join(chr(first + int(c)) for c in rng.integers(0, 3000, 6000))
        edits = ["X" + text, text[:3000] + "X" + text[3000:], text[:3000] + text[3001:]]
        got = _tuples(spark, [text, *edits])
        assert all(len(set(got[0]) & set(got[i])) / 64 > 0.9 for i in (1, 2, 3))
    wide = "".join(chr(0x20000 + i) for i in range(20))
    texts = ["", " one  sixteencharacters sixteencharacter\x1c x\ny ", wide, "a" * 16, "a" * 17, "日本 " + wide[:16]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", F.expr(f"regexp_extract_all(text, '{order_minhash.PIECE}', 1)").alias("p")).collect()
    for r in got:
        runs = re.findall(r"[^\x20\x09-\x0D]+", texts[r["i"]])
        assert r["p"] == [w[k:k + 16] for w in runs for k in range(max(1, len(w) - 15))]


def test_order_minhash_next(spark):
    ids = [*range(0, 40, 2), 101, 100, 100, None]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = order_minhash.with_next(df, "doc_id", {"text": "after"}, ["text"], 5).collect()
    line = sorted(((-math.inf if i is None else i, f"t{n}") for n, i in enumerate(ids)), key=lambda x: (-x[0], x[1]))
    want = {line[k][1]: line[(k + 1) % len(line)][1] for k in range(len(line))}
    assert len(got) == len(ids) and {r["text"]: r["after"] for r in got} == want
    assert order_minhash.with_next(df.limit(0), "doc_id", {"text": "after"}, ["text"], 5).count() == 0


@pytest.mark.parametrize("ids", [[*range(0, 40, 2), 101, 100, 100, None], [None] * 40 + [7] * 50 + [*range(30)], [None] * 9, [5] * 30,
                                 [3], [-2 ** 63, 2 ** 63 - 1, None, 0]])
def test_order_minhash_next_spread(spark, ids):
    """Rows without an id and rows of one hot id lie in several ranges and still follow each other."""
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    line = sorted(df.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    want = {line[k]["text"]: line[(k + 1) % len(line)]["text"] for k in range(len(line))}
    got = order_minhash.with_next(df, "doc_id", {"text": "after"}, ["text"], 5, "h").collect()
    assert len(got) == len(ids) and {r["text"]: r["after"] for r in got} == want


def test_archives(spark):
    big = "<p>" + "ä" * 900 + "</p>"
    rows = [(1, "http://a/x y", big), (2, None, big), (3, "http://c", None), (4, "http://d", "small"), (5, "http://e", "small"),
            (None, "http://f", big), (7, "http://g", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n" * 60), (8, "u", "\n" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in arc_warc.pages_through_archives(pages).collect()}
    for page_id, _, html in rows:
        body = (html or "").encode()
        assert (got[page_id]["payload_bytes"], got[page_id]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
    assert {k: r["refers_to"] for k, r in got.items() if r["record_type"] == "revisit"} == {1: 2, None: 2}
    assert arc_warc.pages_through_archives(pages.limit(0)).count() == 0


def test_record_ids_of_archives_with_one_name(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        block = arc_warc.http_block(1, folder.encode() * 600)
        (tmp_path / folder / "p.arc").write_bytes(arc_warc.version_block(1, "p.arc", "20240101000000") + b"\n" + arc_warc.arc_header(
            1, "http://a/", "1.2.3.4", "20240101000000", "text/html", block, 0) + block)
    ids = [r["record_id"] for r in arc_warc.read_arc(spark, f"{tmp_path}/*").collect()]
    again = [r["record_id"] for r in arc_warc.read_arc(spark, f"{tmp_path}/*").collect()]
    assert len(set(ids)) == 2 and sorted(ids) == sorted(again)


def test_arc_versions():
    for version in (1, 2):
        block = arc_warc.http_block(5, b"body\n\nwith lines")
        data = arc_warc.version_block(version, "x", "20240101000000") + b"\n" + arc_warc.arc_header(
            version, "http://a/", "1.2.3.4", "20240101000000", "text/html", block, 0) + block + b"\n"
        (_, fields, got), = arc_warc.parse_arc(data)
        assert got == block and fields["IP-address"] == "1.2.3.4" and fields["URL"] == "http://a/"
        with pytest.raises(ValueError):
            list(arc_warc.parse_arc(data[:-8]))
        # an old URL may hold spaces
        odd = arc_warc.version_block(version, "x", "20240101000000") + b"\n" + arc_warc.arc_header(
            version, "http://a/", "1.2.3.4", "20240101000000", "text/html", block, 0).replace(b"http://a/", b"http://a/x y") + block
        (_, fields, _), = arc_warc.parse_arc(odd)
        assert (fields["URL"], fields["IP-address"], fields["Archive-date"]) == ("http://a/x y", "1.2.3.4", "20240101000000")
        # a damaged header, and one whose length runs past the end, cost their own records only
        record = data[data.index(b"\nhttp://a/") + 1:]
        hurt = data[:-len(record)] + record + b"garbage line\n" + record.replace(b"1.2.3.4 ", b"") + record + record[:-9]
        with pytest.raises(ValueError):
            list(arc_warc.parse_arc(hurt))
        found = [r[2] for r in arc_warc.parse_arc(hurt, skip_damaged=True)]
        assert found == [block, block]
    assert arc_warc.warc_date("20240101020304") == "2024-01-01T02:03:04Z"


def test_bpe_equals_tiktoken(spark, odd):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    random = ["".join(chr(c) for c in rng.choice([*range(0, 0x250), *range(0x4E00, 0x4E20), 0x1F600, 0x2003], 60)) for _ in range(200)]
    texts = [t for _, t, *_ in ODD] + random + ["a" * 5000, " " * 300 + "\n\n x", "<|endoftext|> don't I'll"]
    codec = sp_bpe.share_codec(spark, path, P.PATTERN)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    df = df.select("i", sp_bpe.encode(F.col("text"), codec).alias("ids"))
    for r in df.select("i", "ids", sp_bpe.decode(F.col("ids"), codec).alias("back")).collect():
        assert r["ids"] == want.encode_ordinary(texts[r["i"]] or "")
        assert bytes(r["back"]) == (texts[r["i"]] or "").encode()
    tokens = sp_bpe.read_ranks(path)
    encoder = sp_bpe.PieceEncoder(sp_bpe.model_bytes(tokens), tokens, P.PATTERN)
    long = "some words 12 and more,  " * 40000
    assert np.frombuffer(encoder.encode([long])[0], "<i4").tolist() == want.encode_ordinary(long)


def test_latin_pattern():
    """Written-out classes cut Latin-1 texts as the pattern does, for every character and neighbour."""
    import public_tokenizers as P
    import regex

    latin, pattern = sp_bpe.latin_pattern(P.PATTERN), regex.compile(P.PATTERN)
    rng = np.random.default_rng(7)
    texts = ["".join(chr(a) + chr(b) for b in range(256)) for a in range(256)]
    texts += ["".join(map(chr, rng.choice([32, 9, 10, 13, 28, 31, 39, 115, 116, 65, 95, 133, 160, 178, 188, 215, 233, 50], 80))) for _ in range(2000)]
    assert all(latin.findall(t) == pattern.findall(t) for t in texts)
    assert sp_bpe.latin_pattern(r"\p{Lu}+|.") is None and sp_bpe.latin_pattern(r"[\S]") is None
    encoder = sp_bpe.PieceEncoder(sp_bpe.model_bytes(sp_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))),
                                  sp_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    assert encoder.pattern_for("é") is encoder.latin and encoder.pattern_for("日") is encoder.pattern


def _highest_quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_sainte_lague():
    rng = np.random.default_rng(4)
    for _ in range(60):
        votes = [float(v) for v in rng.integers(1, 1000, rng.integers(1, 9))]
        seats = int(rng.integers(0, 120))
        assert mixing.sainte_lague(votes, seats) == _highest_quotients(votes, seats)
    assert mixing.sainte_lague([5.0, 1.0], 10, [2, 100]) == [2, 8]
    assert mixing.capped_targets([10, 100, 100], [100, 1, 1]) == [30.0, 90.0, 90.0]


def test_mixing(spark, odd):
    rows = [(100 + i, "w " * (1 + i * 7 % 50), "en", f"s{i % 4}", 1) for i in range(200)]
    docs = odd.unionByName(spark.createDataFrame(rows, DOCS))
    mixed = mixing.mix_sources(docs, block=4, shard_docs=20)
    again = mixing.mix_sources(docs.repartition(7), block=4, shard_docs=20)
    taken = [(r["doc_id"] or 0, r["size"], r["taken"]) for r in mixed.collect()]
    assert sorted(taken) == sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in again.collect())
    assert all(t <= 3 * s for _, s, t in taken)
    for r in mixed.groupBy("source").agg(F.sum("size").alias("n"), F.max("source_size").alias("s"), F.max("target").alias("t"),
                                         F.sum("taken").alias("k")).collect():
        assert r["n"] == r["s"] and abs(r["k"] - r["t"]) <= 16
    out = mixing.mixed_documents(mixed)
    words = out.withColumn("n", mixing.word_count(F.col("text"))).agg(F.sum("n")).first()[0]
    assert out.columns == docs.columns and words == sum(t for *_, t in taken)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_small_sources(spark):
    """Sources of a few words are taken near their target, as the large ones are."""
    rows = [(i, "w " * 40, "en", f"big{i % 3}", 1) for i in range(120)]
    rows += [(1000 + i, "a b", "en", f"tiny{i % 6}", 1) for i in range(12)] + [(2000, "one", "en", "lone", 1)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, DOCS))
    got = mixed.groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert len(got) == 10 and all(r["k"] > 0 and abs(r["k"] - r["t"]) <= 1 for r in got)
    kept = mixing.mixed_documents(mixed)
    assert kept.select("source").distinct().count() == 10


def _kt(zeros, ones):
    p, a, b = 1.0, 0, 0
    for bit in [0] * zeros + [1] * ones:
        p *= ((b if bit else a) + 0.5) / (a + b + 1)
        a, b = a + (bit == 0), b + (bit == 1)
    return p


def test_context_tree_brute_force():
    assert np.allclose(ctw.log_kt(np.array([0, 3, 5]), np.array([0, 1, 9])), [math.log(_kt(*x)) for x in ((0, 0), (3, 1), (5, 9))])
    depth, texts = 2, [ctw.model_bytes(t) for t in (b"abab abba", b"abc", b"bb a")]
    grams = np.concatenate([g for _, g in ctw.gram_windows(texts, depth)])
    own, n = np.unique(grams, return_counts=True)
    tables, _ = ctw.descend(ctw.climb(ctw.kept_levels(own, n, 0, depth, 1)))
    counts = {}
    for g in grams.tolist():
        byte = g & 255
        for d in range(depth + 1):
            for t in range(8):
                c = counts.setdefault((d, g >> 8 & (1 << 8 * d) - 1, 1 << t | byte >> 8 - t), [0, 0])
                c[byte >> 7 - t & 1] += 1

    def weighted(d, context, node):
        if (d, context, node) not in counts:
            return 1.0
        own = _kt(*counts[d, context, node])
        if d == depth:
            return own
        return 0.5 * own + 0.5 * math.prod(weighted(d + 1, x << 8 * d | context, node) for x in {10, 32, 97, 98, 99})

    def probability(d, context, node, bit):
        """Of a bit after a context of all bytes, mixed from depth d on."""
        key = (d, context & (1 << 8 * d) - 1, node)
        if key not in counts:
            return 0.5
        estimate = (counts[key][bit] + 0.5) / (sum(counts[key]) + 1)
        if d == depth:
            return estimate
        own = _kt(*counts[key])
        below = 2 * weighted(*key) - own
        return (own * estimate + below * probability(d + 1, context, node, bit)) / (own + below)

    for gram in [*np.unique(grams).tolist(), *[a << 16 | b << 8 | c for a in (97, 120) for b in (98, 121) for c in (97, 122)]]:
        byte = gram & 255
        want = sum(math.log2(probability(0, gram >> 8, 1 << t | byte >> 8 - t, byte >> 7 - t & 1)) for t in range(8))
        assert abs(ctw.log2_probability(np.array([gram], np.uint64), tables)[0] - want) < 1e-5
    total = sum(2 ** ctw.log2_probability(np.array([97 << 16 | 98 << 8 | x], np.uint64), tables)[0] for x in range(256))
    assert abs(total - 1) < 1e-5


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_context_tree_in_parts(spark, depth):
    """Dealt into parts, the tree gives what it gives in one piece, for grams seen, rare and never seen; looked up
    in the broadcast table or joined, the scores are those of the texts' bytes."""
    texts = [PROSE["en"] * 2 + "xyz", PROSE["de"], "the hat of the cat", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    learned = [ctw.model_bytes((t or "").encode()) for t in texts[:2]]
    own, n = np.unique(np.concatenate([g for _, g in ctw.gram_windows(learned, depth)]), return_counts=True)
    tables, _ = ctw.descend(ctw.climb(ctw.kept_levels(own, n, 0, depth, 2)))
    want = [sum(ctw.log2_probability(g, tables).sum() for _, g in ctw.gram_windows([ctw.model_bytes((t or "").encode())], depth))
            * math.log10(2) for t in texts]
    for head in (0, 40, 1 << 20):
        got = ctw.score_documents(docs, F.col("doc_id") < 2, depth=depth, least=2, head_grams=head).orderBy("doc_id").collect()
        assert [r["score"] for r in got] == pytest.approx(want, abs=1e-3)


def test_scores(spark, odd):
    rows = [(i, PROSE["en"] * 3 if i % 2 else PROSE["de"] * 2, "en", "s", 1) for i in range(20, 60)]
    docs = odd.unionByName(spark.createDataFrame(rows, DOCS))
    train = (F.col("doc_id") >= 20) & (F.col("doc_id") < 50)
    for head in (0, 1000):
        got = {r["doc_id"]: r for r in ctw.score_documents(docs, train, depth=3, head_words=head).collect()}
        words = [w for i, t, *_ in rows if i < 50 for w in t.split()]
        n, v = len(words) + 30, len(set(words)) + 1
        for i, t, *_ in rows:
            want = sum(math.log10((words.count(w) + 1) / (n + v + 1)) for w in t.split()) + math.log10(31 / (n + v + 1))
            assert abs(got[i]["base_score"] - want) < 1e-6 and got[i]["train_tokens"] == n
            assert got[i]["n_known"] == got[i]["n_tokens"] == len(t.split()) + 1
    assert got[55]["score"] > got[55]["base_score"] and got[1]["n_tokens"] == 1 and got[1]["score"] == got[2]["score"]
    assert ctw.score_documents(docs, F.lit(False)).where("doc_id = 2").first()["score"] == pytest.approx(8 * math.log10(0.5))
    assert ctw.score_documents(docs.limit(0), train).count() == 0


def test_shards(spark, odd):
    rows = [(100 + i, f"t{i}", "en", "big" if i % 3 else f"s{i % 7}", 1) for i in range(300)]
    docs = odd.unionByName(spark.createDataFrame(rows, DOCS))
    got = sharding.stratified_shards(docs, 8, bucket_rows=16)
    again = sharding.stratified_shards(docs.repartition(5), 8, bucket_rows=16)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    rows = got.collect()
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    counts = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert len(rows) == 308 and max(counts) - min(counts) <= 1
    big = [sum(r["shard"] == s and (r["doc_id"] or 0) >= 100 and (r["doc_id"] - 100) % 3 > 0 for r in rows) for s in range(8)]
    assert max(big) - min(big) <= 2
    texts = {i: t for i, t, *_ in ODD}
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows if r["doc_id"] in texts)
    assert sharding.stratified_shards(docs.limit(0)).count() == 0


def _shards(docs, n_shards, bucket_rows, seed=42):
    """The sharding law by plain sorting: seeded order in each source, fractional ranks, equal pieces."""
    by_key, rows = {}, []
    for i, text, src in docs:
        body = (text or "").encode()
        key = (i, "t" if src is None else "s" + src, zlib.crc32(body), len(body) + 1)
        by_key[key] = by_key.get(key, 0) + 1
    for (i, src, crc, size), n in by_key.items():
        for copy in range(n):
            rows.append((i, src, crc, size, copy if n > bucket_rows else 0))
    return rows


def test_shards_of_one_hot_text(spark):
    """A third of the rows without an id and of one text: no bucket holds them all, reruns agree, and the law holds."""
    rows = [(None, "the same text", "en", "big", 1)] * 300 + [(i, f"t{i}", "en", "big" if i % 3 else "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    seen = []
    with_rank = sharding.with_rank
    try:
        sharding.with_rank = lambda r, group, bucket, order, out: seen.append(
            r.groupBy(*group, bucket).count().agg(F.max("count")).first()[0]) or with_rank(r, group, bucket, order, out)
        got = sharding.stratified_shards(docs, 8, bucket_rows=32).collect()
    finally:
        sharding.with_rank = with_rank
    assert max(seen) < 100
    again = sharding.stratified_shards(docs.repartition(7), 8, bucket_rows=32).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 900
    hot = [sum(r["doc_id"] is None and r["shard"] == s for r in got) for s in range(8)]
    assert sum(hot) == 300 and min(hot) > 15


def test_shards_brute_force(spark):
    """The registered query's shards and slots by plain sorting of the same seeded order."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = _shards([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], 8, 8192)
    hashes = spark.createDataFrame(want, "id long, src string, crc long, size long, copy long").withColumn(
        "h", F.xxhash64(F.lit(42), F.col("id").cast("string"), "crc", "size", "copy").bitwiseAND(F.lit((1 << 52) - 1))).collect()
    line = []
    for src in {r["src"] for r in hashes}:
        own = sorted((r for r in hashes if r["src"] == src), key=lambda r: (r["h"], r["id"]))
        line += [((2 * i + 1) / (2 * len(own)), src, i, r) for i, r in enumerate(own)]
    line.sort(key=lambda x: x[:3])
    n, expected = len(line), {}
    for at, (*_, r) in enumerate(line):
        shard = at * 8 // n
        expected[r["id"]] = (shard, at - (shard * n + 7) // 8)
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in LLM_QUERIES["op10_stratified_shards"](spark, SF_SMALL).collect()}
    assert got == expected


def test_copy_numbers(spark):
    from journeykit.llm.storage import copy_numbers
    rows = spark.createDataFrame([(None, "a", i % 5) for i in range(100)] + [(1, "b", 7), (1, "b", 8), (2, None, 0)],
                                 "k long, t string, other int").repartition(9).checkpoint()
    got = copy_numbers(rows, ["k", "t"], 10, "no").collect()
    assert sorted(r["no"] for r in got if r["k"] is None) == list(range(100)) and len(got) == 103
    assert all(r["no"] == 0 for r in got if r["k"] is not None)
    assert {r["no"] for r in copy_numbers(rows, ["k", "t"], 1000, "no").collect()} == {0}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF_SMALL)
    assert kept.columns == names and kept.count() == docs.count()
    extra = docs.unionByName(spark.createDataFrame([(-1, None, "en", "x", 0), (-2, "12 ... 34", "en", "x", 9)], DOCS))
    assert stages["language_id"](spark, extra, SF_SMALL).where("doc_id < 0").count() == 0
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.where("not round_trip").count() == 0 and out.count() > 0
    assert out.select("doc_id").distinct().count() <= docs.count()
