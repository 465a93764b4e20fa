"""Line dedup and mixing against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lingsmith.llm import linededup, mixing
from lingsmith.llm.queries import op7_line_dedup, op8_source_mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n_lines int, epoch int, key string"
ODD = [(None, None, None, 1, 1, "k"), (1, "", "a", 1, 1, "k"), (2, "same line of text\nother line here", "a", 1, 1, "k"), (2, "same line of text\nother line here", "a", 1, 1, "k"), (3, "other line here\n\nmine alone it is", None, 1, 1, "k"), (4, "same line of text\nother line here", "b", 1, 1, "k"), (5, "\n".join(f"line number {i}" for i in range(3000)), "b", 1, 1, "k")]


def plain_lines(rows, every_pair=False):
    """(id, text) -> places to delete: runs of lines as strings in a dictionary, then the same alignment.

    every_pair: each document is aligned with all earlier ones.
    """
    order = sorted(rows, key=lambda r: r[0])
    size = lambda x: len(x.encode())
    holders, gone = defaultdict(list), defaultdict(set)
    lines = {k: [x.strip() for x in k[1].split("\n")] for k in order}
    for k in order:
        full = [x for x in lines[k] if x]
        for i in range(len(full)):
            for least in (1, 2):
                run = next((full[i : j + 1] for j in range(i + least - 1, len(full)) if sum(map(size, full[i : j + 1])) >= linededup.LEAST), None)
                if run and k not in holders[tuple(run)]:
                    holders[tuple(run)].append(k)
    pairs = set()
    for h in holders.values():
        pairs |= {(x, y) for i, y in enumerate(h) for x in (h[:i] if len(h) <= linededup.RARE else h[:1] if i else [])}
    if every_pair:
        pairs = {(x, y) for i, y in enumerate(order) for x in order[:i]}
    number = {x: i for i, x in enumerate({x for v in lines.values() for x in v if x}, 1)}
    for x, y in pairs:
        a, b = ([number.get(s, 0) for s in lines[k]] for k in (x, y))
        inside = lambda v, p, q: [z for z in v[p + 1 : q] if z]
        block: list = []
        for i, j in [*linededup.patience(a, b), (None, None)]:
            if block and (i is None or inside(a, block[-1][0], i) or inside(b, block[-1][1], j)):
                if sum(size(lines[y][q]) for _, q in block) >= linededup.LEAST:
                    gone[y] |= {q for _, q in block}
                block = []
            block.append((i, j))
    return gone


def test_line_dedup(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    gone = plain_lines([(d, t) for d, t in docs.items() if t])
    got = {r.doc_id: r for r in op7_line_dedup(spark, SF).collect()}
    assert len(got) == len(docs) and sum(map(len, gone.values())) > 20
    for d, t in docs.items():
        left = [x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())]
        assert got[d].n_removed == len(gone.get((d, t), ()))
        assert got[d].text == (t if (d, t) not in gone else "" if not any(x.strip() for x in left) else "\n".join(left))


def test_lines_of_every_pair():
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["text"]]
    few, every = plain_lines(docs), plain_lines(docs, every_pair=True)
    assert all(few[k] <= every[k] for k in every) and sum(map(len, few.values())) >= 0.98 * sum(map(len, every.values()))


def test_short_and_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "FOLLOWERS", 5)
    verse = ["rose", "is", "a", "rose"]
    rows = [(1, "\n".join(verse)), (2, "\n".join(["mine is this one", *verse])), (3, "rose"), (4, "rose"), (5, "a\n\nrose")]
    rows += [(i, f"a line that a third of all rows hold\nown words of {i}") for i in range(10, 60)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "mine is this one" and got[3] == got[4] == "rose" and got[5] == "a\n\nrose"
    assert got[10] == rows[5][1] and all(got[i] == f"own words of {i}" for i in range(11, 60))


def test_line_dedup_odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    out = linededup.dedup_lines(spark, df)
    assert sorted(out.columns) == sorted(df.columns + ["n_removed"])
    got = Counter((r.doc_id, r.text, r.n_removed) for r in out.collect())
    assert got[(2, ODD[2][1], 0)] == 2 and got[(4, "", 2)] == 1 and got[(3, "\nmine alone it is", 1)] == 1
    assert got[(None, None, 0)] == 1 and got[(1, "", 0)] == 1
    assert linededup.dedup_lines(spark, df.limit(0)).count() == 0


def test_patience():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(1, 12) for _ in range(rng.randrange(0, 15))]
        b = [rng.randrange(1, 12) for _ in range(rng.randrange(0, 15))]
        out = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in out)
        assert all(i < k and j < m for (i, j), (k, m) in zip(out, out[1:]))
    assert linededup.patience([5, 6, 7], [5, 6, 7]) == [(0, 0), (1, 1), (2, 2)] and linededup.patience([0], [0]) == []


def test_mixing_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    tokens, count = Counter(), Counter(r["doc_id"] for r in docs)
    size = {}
    for r in docs:
        size[r["doc_id"]] = len((r["text"] or "").split())
        tokens[r["source"]] += size[r["doc_id"]]
    p = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    lo, hi = 0.0, 1.0
    for _ in range(60):
        a = (lo + hi) / 2
        ratio = [x ** (a - 1) for x in p.values()]
        lo, hi = (lo, a) if max(ratio) / min(ratio) <= 2 else (a, hi)
    times, taken = Counter(), Counter()
    for r in op8_source_mixing(spark, SF).collect():
        times[r.doc_id] += 1
        taken[r.source] += size[r.doc_id]
    assert set(times) == set(count) and max(times.values()) <= 2
    ratio = {s: x ** (hi - 1) for s, x in p.items()}
    for s in p:
        want = ratio[s] / min(ratio.values()) * tokens[s]
        assert want - max(size.values()) <= taken[s] <= want * (1 + 1e-6) + 1


def test_entropy_and_budget(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i % 10 else ("b" if i % 20 else None)) for i in range(4000)], "doc_id long, text string, source string")
    goal = 0.8
    out = Counter(r.source for r in mixing.mix(spark, df, entropy=goal, repetition=None, budget=1.0).collect())
    share = [n / sum(out.values()) for n in out.values()]
    assert abs(-sum(x * math.log(x) for x in share) - goal) < 0.01 and abs(sum(out.values()) - 4000) <= 3
    capped = Counter(r.doc_id for r in mixing.mix(spark, df, repetition=3.0, budget=1.0).collect())
    assert max(capped.values()) <= 3


def test_mixing_odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    out = mixing.mix(spark, df)
    got = Counter(r.doc_id for r in out.collect())
    assert set(got) == {r[0] for r in ODD} and got[2] >= 2
    assert sorted(out.columns) == sorted(df.columns + ["place"])
    assert mixing.mix(spark, df.limit(0)).count() == 0


def test_next_holders(spark):
    a, b, c = "line a of the block", "line b of the block", "line c of the block"
    texts = [[c, b, a], [a, b, c, "u alone in its text"], [a, b, c, "v alone in its text"]]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(spark, df).collect()}[2] == "v alone in its text"


def test_patience_of_repeated_lines():
    assert linededup.patience([1, 2, 3, 2, 3, 4], [5, 2, 3, 2, 3, 6]) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert linededup.patience([7, 2, 0, 2, 8], [9, 2, 5]) in ([(1, 1)], [(3, 1)])
    assert len(linededup.patience([1, 3] * 50 + [2], [5] + [3, 1] * 50)) == 99
