"""Embedding links against comparing all vectors."""

import math

import numpy as np
import pyarrow.parquet as pq

from lingsmith.llm import nndescent
from lingsmith.llm.queries import op2_embedding_nn_descent


def plain(rows, least):
    ok = [(i, lab, np.array(v, float)) for i, lab, v in rows if lab is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.linalg.norm(v) > 0]
    comp = {i: i for i, _, _ in rows}
    n = dict.fromkeys(comp, 0)
    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, x, u), (j, y, v) = ok[a], ok[b]
            if x == y and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                p, q = comp[i], comp[j]
                comp = {k: min(p, q) if c in (p, q) else c for k, c in comp.items()}
    return sorted((i, n[i], comp[i], comp[i] == i) for i, _, _ in rows)


def links_of(df):
    assert df.select("audited_recall").distinct().count() <= 1
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()))


def test_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in pq.read_table(f"{path}/embeddings.parquet").to_pylist()]
    assert links_of(op2_embedding_nn_descent(spark, path)) == plain(rows, 0.93)


def test_odd(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    rows = [(k, 1, (base + 0.05 * rng.normal(size=8)).tolist()) for k in range(40)]
    rows += [(50, None, base.tolist()), (51, 1, None), (52, 1, [0.0] * 8), (53, 1, [float("nan")] * 8), (54, 1, [None] * 8), (55, 2, base.tolist()), (56, 2, base.tolist()), (57, 1, [1.0]), (58, 1, [2.0]), (59, 2, (1e-3 * base).tolist())]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, embedding array<double>, id int")
    assert links_of(nndescent.links(spark, df)) == plain(rows, 0.93)
    assert nndescent.links(spark, df.limit(0)).count() == 0


def test_huge_and_tiny_vectors_and_labels(spark):
    v = np.array([1.0, 2.0, -1.0])
    rows = [(k, lab, (size * v).tolist()) for k, (lab, size) in enumerate([("a", 1e200), ("a", 1e200), ("a", 1e-200), ("b", 1e-200), ("b", 1.0), ("1.5", 1.0), ("1", 1.0)])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    assert [r[1] for r in links_of(nndescent.links(spark, df))] == [2, 2, 2, 1, 1, 0, 0]
    halves = spark.createDataFrame([(1, 1.5, v.tolist()), (2, 1.25, v.tolist()), (3, 1.5, v.tolist())], "vec_id long, label double, embedding array<double>")
    assert [r[2] for r in links_of(nndescent.links(spark, halves))] == [1, 2, 1]


def test_recall_of_lists():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 64))
    x[300:] = x[:300] + 0.15 * rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near, _ = nndescent.nn_descent(x.astype(np.float32), 16, rng, 0.93)
    assert np.mean([k + 300 in near[k] for k in range(300)]) > 0.95


def test_two_groups_of_copies(spark):
    u, v = np.eye(8)[0], 0.95 * np.eye(8)[0] + math.sqrt(1 - 0.95**2) * np.eye(8)[1]
    rng = np.random.default_rng(2)
    rows = [(k, 1, (u if k < 100 else v).tolist()) for k in range(200)]
    rows += [(k, 2, ((u if k < 400 else v) + 1e-4 * rng.normal(size=8)).tolist()) for k in range(300, 500)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert links_of(nndescent.links(spark, df)) == plain(rows, 0.93)


def test_pairs_beside_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = rng.normal(size=(3000, 32))
    off -= (off * x).sum(1)[:, None] * x
    y = 0.935 * x + math.sqrt(1 - 0.935**2) * off / np.linalg.norm(off, axis=1)[:, None]
    rows = [(k, 1, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))] + [(k, 1, [1.0] + [0.0] * 31) for k in range(6000, 9000)]
    got = {r.vec_id: r.n_links for r in nndescent.links(spark, spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(8)).collect()}
    assert sum(got[k] >= 1 for k in range(6000)) >= 0.995 * 6000
    assert all(got[k] >= 2999 for k in range(6000, 9000))
