"""Suffix dedup against a dictionary of all strings."""

import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq

from lingsmith.llm import suffixes
from lingsmith.llm.queries import op5_bwt_dedup

SF = "/root/testdata/sf0.001"


def plain(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(hash(t[i : i + length]) for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    want = plain(docs, 400)
    assert sorted(map(tuple, op5_bwt_dedup(spark, SF).collect()), key=str) == want and sum(r[2] > 0 for r in want) > 5


def odd_rows():
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["ab", "ñandú", "xyz", "q"]) + str(rng.randrange(10**4)) for _ in range(n))
    share = words(60)
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (4, "short"), (5, words(30) + share + words(30)), (6, share + words(9)), (7, words(50) + share[:450]), (8, "ab " * 3000), (9, words(20) + "The " * 400 + "x " * 300), (None, words(80))]
    copy = words(100)
    return rows + [(10, copy), (11, copy), (11, copy), (12, copy[:500] + "!" + copy[501:]), (13, "é" * 900), (14, words(40) + copy[100:520] + words(40) + copy[100:520])]


def test_odd(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    want = plain(rows, 400)
    assert sorted(map(tuple, suffixes.dedup(spark, df).collect()), key=str) == want
    assert suffixes.dedup(spark, df.limit(0)).count() == 0


def test_hot_passage(spark):
    """A passage that most rows share, whole and cut, among copies of whole texts."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    hot, copy = words(120), words(150)
    rows = [(i, words(rng.randrange(5, 40)) + " " + (hot if i % 3 else hot[: rng.randrange(300, 700)]) + " " + words(20)) for i in range(150)]
    rows += [(1000 + i, copy if i % 2 else words(80)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = plain(rows, 400)
    assert sorted(map(tuple, suffixes.dedup(spark, df).collect()), key=str) == want and sum(r[2] > 0 for r in want) > 100


def test_shards_and_hot_groups(monkeypatch):
    texts = [(t or "").encode() for _, t in odd_rows() if t]
    want = [[i for i in range(len(t) - 399) if sum(u.count(t[i : i + 400]) + (u.find(t[i : i + 400], u.find(t[i : i + 400]) + 1) > 0) for u in texts) > 1] for t in texts]
    monkeypatch.setattr(suffixes, "SHARD", 3000)
    assert [x.tolist() for x in suffixes.repeats(texts, 400)] == want
    monkeypatch.setattr(suffixes, "MOST", 10)
    assert [x.tolist() for x in suffixes.repeats(texts, 400)] == want
