"""The registered queries against plain Python, column by column, on whole tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from journeykit.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _run(spark, name):
    return LLM_QUERIES[name](spark, SF).collect()


def _bucket(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_simhash_query(spark, docs):
    prints = {}
    for i, r in docs.items():
        words = WORD.findall((r["text"] or "").translate(UPPER))
        shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)][:len(words)]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    low = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and low[b] < low[a]:
                    low[a], moved = low[b], True
    got = _run(spark, "op2_simhash_near_dedup")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", low[i]) for i in ids}


def _kmer_hash(*values, seed=42):
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def _order_minhash(text, k=3, selected=65, size=2, mask=(1 << 39) - 1):
    """Numbered k-mers of smallest hash, in text order, hashed in pairs."""
    pieces = [w[i:i + 16] for w in WORD.findall(text) for i in range(max(1, len(w) - 15))]
    if not pieces:
        return ""
    if len(pieces) < k:
        kmers = [_kmer_hash(" ".join(pieces)) & mask]
    else:
        kmers = [_kmer_hash(*pieces[i:i + k]) & mask for i in range(len(pieces) - k + 1)]
    seen, numbered = Counter(), []
    for at, h in enumerate(kmers):
        numbered.append((_kmer_hash((h, 8), (seen[h], 4)) & mask, at))
        seen[h] += 1
    chosen = [h for h, _ in sorted(sorted(numbered)[:selected], key=lambda x: x[1])]
    if len(chosen) < size:
        tuples = [_kmer_hash(" ".join(map(str, chosen)))]
    else:
        tuples = [_kmer_hash(*[(h, 8) for h in chosen[i:i + size]]) for i in range(len(chosen) - size + 1)]
    return "".join(f"{t & 0xFFFFFFFF:08x}" for t in tuples)


def _near(a, b):
    a, b = ({x[i:i + 8] for i in range(0, len(x), 8)} for x in (a, b))
    return len(a & b) / max(len(a), len(b)) if a or b else 1.0


def test_order_minhash_query(spark, docs):
    ids = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in _run(spark, "op5_order_minhash")}
    assert sorted(got) == sorted(ids)
    for at, i in enumerate(ids):
        text, after = docs[i]["text"] or "", docs[ids[(at + 1) % len(ids)]]["text"] or ""
        take = len(text) // 3
        edited = text[:len(text) - take] + after[:take]
        own, changed, following = map(_order_minhash, (text, edited, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, changed), i
        assert (r["near_edited"], r["near_next"]) == pytest.approx((_near(own, changed), _near(own, following)))


def test_bpe_query(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in _run(spark, "op7_sentencepiece_bpe")}
    want = {}
    for i, r in docs.items():
        ids = encoding.encode_ordinary(r["text"] or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert got == want


def _targets(sizes, weights):
    """Shares of all sizes by weight; what is above three times a size is shared again by the others."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(3 * sizes[i] for i in capped)
        target = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free} | {i: 3.0 * sizes[i] for i in capped}
        over = {i for i in free if target[i] > 3 * sizes[i]}
        if not over:
            return [target[i] for i in range(len(sizes))]
        capped |= over


def test_mixing_query(spark, docs):
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in docs.items()}
    sources = sorted({r["source"] for r in docs.values()}, key=lambda s: (s is None, s or ""))
    sums = [sum(size[i] for i, r in docs.items() if r["source"] == s) for s in sources]
    target = dict(zip(sources, _targets(sums, [1 + i % 3 for i in range(len(sources))])))
    taken = defaultdict(int)
    rows = _run(spark, "op8_mix_sources")
    for r in rows:
        src = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sums[sources.index(src)])
        assert r["target"] == pytest.approx(target[src]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[src] += r["taken"]
    assert len(rows) == len(docs) and all(abs(taken[s] - target[s]) <= 1 for s in sources)


def test_scores_query(spark, docs):
    words = {i: WORD.findall((r["text"] or "").translate(UPPER)) for i, r in docs.items()}
    trained = [i for i in docs if _bucket(i, 7) != 2]
    counts = Counter(w for i in trained for w in words[i])
    n, v, ends = sum(counts.values()) + len(trained), len(counts) + 1, len(trained)
    rows = _run(spark, "op9_context_tree_scores")
    assert len(rows) == len(docs)
    for r in rows:
        own = words[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((ends + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            _bucket(r["doc_id"], 7) == 2, len(own) + 1, sum(w in counts for w in own) + 1, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_language_query(spark, docs):
    rows = _run(spark, "op3_language_id")
    known = {r["lang"] for r in docs.values() if r["lang"] is not None}
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]["text"] or ""
        assert r["held_out"] == (_bucket(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in known or r["lang_pred"] == "und"
        assert r["lang_pred"] == "und" or any(c.isalpha() for c in text)


def test_shards_query(spark, docs):
    rows = _run(spark, "op10_stratified_shards")
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(docs) and max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    for r in rows:
        body = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "rows", None)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
