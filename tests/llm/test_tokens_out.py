"""Packing, token shards and fingerprints against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lingsmith.llm import _tokens, fingerprint, packing, wavelet
from lingsmith.llm._text import raw
from lingsmith.llm._tokens import word_tokens
from lingsmith.llm.queries import op3_best_fit_packing, op9_fingerprints, op10_wavelet_tokens

SF = "/root/testdata/sf0.001"
ODD = [(5, None, "x"), (1, "", "x"), (3, "dup", "y"), (3, "dup", "y"), (None, "no id", None), (9, "İ'm It's DON'T’s  ³x² a_b́ é é <|endoftext|> ſ 12'st \x1c z", "x"), (2, "word " * 9000, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, bucket string").withColumn("shard", F.lit(1)).withColumn("digest", F.lit("d"))


def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return sorted((r["doc_id"], r["text"] or "") for r in t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packed(rows, size, tokens):
    """Pieces cover each document; sequences are gapless."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert set(by_doc) == set(tokens)
    for doc, ids in tokens.items():
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids) and all(r["length"] == size for r in own[1:])
    return len(by_seq)


def test_packing(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {d: tok.encode(t, add_special_tokens=False).ids + [0] for d, t in docs()}
    n = check_packed(op3_best_fit_packing(spark, SF).collect(), 2048, tokens)
    total = sum(map(len, tokens.values()))
    assert n <= 1.05 * -(-total // 2048) + 1


def test_packing_odd(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(spark, odd, path, size=64, open_bins=2).collect()
    tok = Tokenizer.from_file(path)
    assert sum(r["length"] for r in rows) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ODD)
    assert packing.pack(spark, odd.limit(0), path).count() == 0
    assert max(r["length"] for r in rows) == 64


def test_open_bins():
    rng = np.random.default_rng(1)
    bins, used = packing.OpenBins(100, 8), {}
    for n in rng.integers(1, 101, 3000).tolist():
        b, o = bins.put(n)
        assert o == used.get(b, 0)
        used[b] = o + n
        assert used[b] <= 100 and bins.count <= 8
    assert sum(used.values()) / (100 * len(used)) > 0.85
    assert packing.pieces(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.pieces(8, 4) == [(0, 4), (4, 4)]


def plain_tokens():
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, out = 0, []
    for d, t in docs():
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_wavelet_query(spark):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op10_wavelet_tokens(spark, SF).collect())
    assert got == plain_tokens()


def test_wavelet_odd(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = wavelet.read_shards(wavelet.write_shards(spark, odd, path, shard_ids=50)).collect()
    want = sorted(((d is not None, d or 0), crc(tok.encode(t or "", add_special_tokens=False).ids + [2])) for d, t, _ in ODD)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids_crc32) for r in got) == want
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert wavelet.read_shards(wavelet.write_shards(spark, odd.limit(0), path)).count() == 0


def test_word_tokens_of_any_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, tok = word_tokens(path), Tokenizer.from_file(path)
    rng = random.Random(8)
    fresh = "\u1c89\ua7cb\U000105c0\u0342\u1df7\u0130\u017f\u00b5\u00aa\u00b3\u2028\x85\x1c\x00\ufeff"
    latin = [chr(c) for c in range(0xA0, 0x250)]
    kinds = [lambda: chr(rng.randrange(1, 128)), lambda: rng.choice(latin), lambda: rng.choice(fresh), lambda: rng.choice(["'s", "'LL ", "don't", " ", "’", "12", "Straße"]), lambda: chr(rng.choice([rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x30000)]))]
    for n in range(20_000):
        use = kinds[: rng.randrange(1, len(kinds) + 1)]
        text = "".join(rng.choice(use)() for _ in range(rng.randrange(0, 24)))
        assert own.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    big = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(rng.integers(0, 3, 700_000).astype(np.uint32), b"table").to_bytes())
    assert big.documents == b"table" and big.access(699_999) == int(big.ids()[-1]) and sorted(big.planes[0]._open) == [2]
    ids = rng.integers(0, 300, 3000).astype(np.uint32)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.of(ids).to_bytes())
    assert (w.ids() == ids).all()
    for i in rng.integers(0, 3000, 60).tolist():
        s = int(ids[i])
        assert w.access(i) == s and w.rank(s, i) == int((ids[:i] == s).sum()) and w.select(s, w.rank(s, i)) == i
    assert w.count(299) == int((ids == 299).sum()) and w.count(70_000) == 0 and w.select(5, 10**6) == -1


def plain_probe(rows):
    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = map(fingerprint.canonical, (t, edited, after))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(a == b), float(a == c)))
    return out


def test_fingerprints(spark):
    got = op9_fingerprints(spark, SF).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == plain_probe(docs())
    by = {}
    for r in got:
        by.setdefault(fingerprint.canonical(dict(docs())[r.doc_id]), set()).add(r.fingerprint)
        assert r.near_edited == float(r.fingerprint == r.edited_fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)


def test_full_buckets(spark):
    """With four bits left, buckets overflow and the bytes decide."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = fingerprint.fingerprints(spark, df, bits=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(fingerprint.canonical(r.text))
    assert all(len(x) == 1 for x in by.values())
    assert len(by) == len({fingerprint.canonical(t) for _, t in docs()})


def test_fingerprints_odd(spark, odd):
    got = fingerprint.probe(spark, odd).collect()
    assert len(got) == len(ODD) and sum(r.doc_id is None for r in got) == 1
    assert len({r.fingerprint for r in got if r.doc_id in (1, 5)}) == 1
    assert fingerprint.probe(spark, odd.limit(0)).count() == 0
    one = fingerprint.probe(spark, odd.filter("doc_id = 9")).collect()
    assert one[0].near_next == 1.0


def test_chunks_are_encoded_once():
    """A text of known chunks is neither cut into pieces nor asked of the library; blanks beyond ASCII part no chunk."""
    own = word_tokens(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("Señor's  Año, ÀÉ\xa0x\x1cy «uno»", "don't\x0bWE'LL <|endoftext|> go", "ñandú İ x", "привет the", "Ⱥ ɏ ŉ ǰ …"):
        assert own.encode_utf8(text.encode()).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids == own.encode(text).tolist()
    assert own.chunks[b"don't"] == own.encode("don't").tobytes() and own.chunks["İ".encode()] is None


def test_new_chunks_of_many_texts_are_learned_together(monkeypatch):
    """Texts side by side: no chunk crosses from one to the next, keys of all sizes are told apart, and each is learned once."""
    own, seen = _tokens.WordTokens(public_tokenizers.path("word_bpe_49k.json")), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda chunks: seen.append(chunks) or learn(chunks))
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeñü0'.,") for _ in range(rng.randrange(1, 40))) for _ in range(4000)] + ["a", "a\0", "a\0\0", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 16 + "\0"]
    texts = ["", "ab", "cd ", "", " ef", "don't", "İ a", "привет the", "a<|endoftext|>b", *(rng.choice([" ", "\n\t"]).join(rng.choices(words, k=200)) for _ in range(60)), ""]
    data, off = raw(pa.array(texts))
    want = [own.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        assert [x.tolist() for x in own.encode_all(data, off)] == want
    assert len(seen) == 1 and len(set(seen[0])) == len(seen[0]) == len({y for x in texts for y in x.encode().split()})
    monkeypatch.setattr(_tokens, "REMEMBERED", 10)
    monkeypatch.setattr(_tokens, "REMEMBERED_PIECES", 10)
    assert [x.tolist() for x in own.encode_all(data, off)] == want and len(seen) == 2
