"""The Jaccard join against comparing all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lingsmith.llm import jaccard
from lingsmith.llm.queries import op4_ngram_jaccard_join

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain(rows, percent, k):
    """(id, text) -> sorted (id, n, component) by all pairs that share an element."""
    found = [(d, plain_set(t, k)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, (_, s) in enumerate(found):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(found):
        for j in {j for x in s for j in by[x] if j > i}:
            t = found[j][1]
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = find(d), find(found[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, s in found)


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = sorted(tuple(r) for r in op4_ngram_jaccard_join(spark, SF).collect())
    want = plain([(r["doc_id"], r["text"]) for r in docs], 90, 3)
    assert got == want and sum(a != c for a, _, c in want) > 30


def near_copies(n, edits):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


def test_near_group(spark, monkeypatch):
    """A large group whose links hold by chains, with lists split into cells."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 40)
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    rows = near_copies(150, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, k in ((90, 3), (80, 5)):
        assert sorted(tuple(r) for r in jaccard.groups(spark, df, percent, k).collect()) == plain(rows, percent, k)


def test_odd(spark):
    rows = [(None, "a b c d e", 1), (7, "A b c D e", 1), (3, None, 1), (4, "", 1), (5, " \t ", 1), (6, "a b", 1), (8, "A  B", 1), (9, "x y z", 1), (9, "x y z", 1), (10, "long " * 60_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(spark, df).collect()}
    assert got == {(None, 3, 7), (7, 3, 7), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (8, 1, 6), (9, 1, 9), (10, 1, 10)}
    assert jaccard.groups(spark, df.limit(0)).count() == 0
    kept = sorted(r.doc_id or 0 for r in jaccard.one_of_each(spark, df.filter("doc_id is not null")).collect())
    assert kept == [3, 4, 5, 6, 7, 9, 10]
    two = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(r.text for r in jaccard.one_of_each(spark, two).collect()) == ["a b c d e f", "g h i j k l"]


def test_open_lists(monkeypatch):
    """Lists of one group go whole; a long list is given out in parts without losing neighbours."""
    rng = random.Random(6)
    rows = []
    for token in range(60):
        groups = rng.choice([1, 1, 2, 5])
        rows += sorted((token, rng.randrange(10, 60), 0, i, rng.randrange(groups)) for i in range(rng.choice([1, 3, 40])))
    want = []
    for token in range(60):
        own = [r for r in rows if r[0] == token]
        near = [any(0 <= j < len(own) and 100 * min(own[i][1], own[j][1]) >= 90 * max(own[i][1], own[j][1]) for j in (i - 1, i + 1)) for i in range(len(own))]
        want += [r for r, ok in zip(own, near) if ok and len({x[4] for x in own}) > 1]
    for held in (100_000, 12):
        monkeypatch.setattr(jaccard, "HELD", held)
        cols = [pa.array(c) for c in zip(*rows)]
        batches = pa.Table.from_arrays(cols, ["token", "size", "pos", "key", "group"]).to_batches(max_chunksize=7)
        got = [tuple(r.values()) for b in jaccard._open(iter(batches), 90) for r in b.to_pylist()]
        assert got == want if held > 12 else set(want) <= set(got) and len(got) == len(set(got))


def test_compared():
    """Pairs that the distances of a group's first member rule out are no candidates by their own sketches either."""
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**63, 400).astype(np.uint64) for _ in range(5)]
    found, group = [], []
    for i in range(80):
        s = base[i % 5].copy()
        s[: rng.integers(0, 60)] = rng.integers(0, 2**63, 1)[0]
        found.append(np.unique(s)), group.append(i % 7)
    order = np.argsort([len(s) for s in found], kind="stable")
    found, group = [found[i] for i in order], np.array(group)[order]
    size, sketches = np.array([len(s) for s in found]), [jaccard.sketch(s) for s in found]
    got = set(zip(*(x.tolist() for x in jaccard.compared(size, np.zeros(80, np.int64), group, sketches, 90, False))))
    want = {(i, j) for j in range(80) for i in range(j) if group[i] != group[j] and 100 * len(np.intersect1d(found[i], found[j])) >= 90 * len(np.union1d(found[i], found[j]))}
    assert want <= got and len(got) < 80 * 79 / 4


def test_sketch_bound():
    rng = np.random.default_rng(2)
    for n in (5, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 20 :], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
        x, y = jaccard.sketch(a), jaccard.sketch(b)
        w = min(len(x), len(y))
        assert np.bitwise_count(jaccard.folded([x], w) ^ jaccard.folded([y], w)).sum() <= len(np.setxor1d(a, b))


def test_stages(spark):
    """Each stage and task costs time however few rows it has: joins and shuffles that nothing needs show in their numbers."""
    rows = [(i, " ".join(f"w{i // 3}x{j + (i % 3) // 2}" for j in range(40))) for i in range(60)]
    spark.sparkContext.setJobGroup("groups", "groups")
    try:
        got = jaccard.groups(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 80).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 3 * 3 for i in range(60)}
    told = spark.sparkContext.statusTracker()
    ran = {s: told.getStageInfo(s) for j in told.getJobIdsForGroup("groups") for s in told.getJobInfo(j).stageIds}
    tasks = [x.numCompletedTasks for x in ran.values() if x and x.numCompletedTasks]
    assert len(tasks) <= 98 and sum(tasks) <= 300
