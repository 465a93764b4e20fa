"""Embedding near-dedup by NN-descent.

Vectors are compared within a label only; equal ones are one vector with a multiplicity. Each round deals a label's
vectors to leaves by random hyperplanes, as many as its size asks for; in a leaf a neighbour graph is refined through the neighbours of neighbours, forward and backward, until it settles;
lists whose every neighbour is within the threshold are saturated and enlarged, and vectors whose lists stay so are
compared with their whole leaf. Edges that meet the threshold, in
double precision, are kept and joined over the rounds, of which a label has so many that a pair at the threshold meets
with the recall asked for. A sample of vectors is audited against all others; rounds are added until the mean over
vectors of the share of links found is the recall asked for, and if it isn't after the last, all vectors of a label
are compared in blocks. Last, the vectors of each component are compared in blocks, so that counts of links inside one
are exact.

Defined cases: null, zero and non-finite vectors, and vectors without a label, link with nothing; vectors of
different lengths don't link; equal vectors link; labels of any type are told apart by their text; rows with the same id count as linked; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingsmith.llm._spark import components, staged, width

LEAF, LONG_LEAF = 1024, 4096
#: Vectors of a chunk, and the base in which a cell's number holds those of its two chunks.
CHUNK, CELLS = 2048, 1_000_000
#: Vectors of an audit, at most, and rounds before the first and before the last.
AUDITED, ROUNDS, MOST_ROUNDS = 400, 4, 16


def nn_descent(x: np.ndarray, k: int, rng: np.random.Generator, within: float, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists (places, cosines) of unit rows x; they are enlarged while some are saturated."""
    n = len(x)
    k = min(k, n - 1)
    near = rng.integers(0, n - 1, (n, k))
    near += near >= np.arange(n)[:, None]
    far = np.einsum("nd,nkd->nk", x, x[near])
    while True:
        for _ in range(rounds):
            # backward neighbours: as many as a list holds, at random
            a, b = near.ravel(), np.repeat(np.arange(n), k)
            mixed = rng.permutation(len(a))
            order = mixed[np.argsort(a[mixed], kind="stable")]
            a, b = a[order], b[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            back = np.tile(np.arange(n)[:, None], (1, k))
            fits = place < k
            back[a[fits], place[fits]] = b[fits]
            hop = rng.permutation(k)[: max(4, min(k, 8))]
            changed = 0
            for lo in range(0, n, 256):
                hi = min(lo + 256, n)
                via = np.concatenate([near[lo:hi][:, hop], back[lo:hi, :8]], 1)
                cand = np.concatenate([near[lo:hi], near[via].reshape(hi - lo, -1), back[lo:hi]], 1)
                cand.sort(1)
                sim = np.einsum("nd,ncd->nc", x[lo:hi], x[cand])
                sim[:, 1:][cand[:, 1:] == cand[:, :-1]] = -2
                sim[cand == np.arange(lo, hi)[:, None]] = -2
                top = np.argpartition(-sim, k - 1, 1)[:, :k]
                new = np.take_along_axis(sim, top, 1)
                changed += int((new.sum(1) > far[lo:hi].sum(1) + 1e-6).sum())
                near[lo:hi], far[lo:hi] = np.take_along_axis(cand, top, 1), new
            if changed <= 0.001 * n:
                break
        if k >= n - 1 or k >= 64 or not (far.min(1) >= within).any():
            return near, far
        more = min(2 * k, n - 1) - k
        extra = rng.integers(0, n - 1, (n, more))
        extra += extra >= np.arange(n)[:, None]
        near, far = np.concatenate([near, extra], 1), np.concatenate([far, np.einsum("nd,nkd->nk", x, x[extra])], 1)
        k += more
        rounds = 3


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles; those that link with nothing go."""
    for batch in batches:
        keep, body = [], []
        for v in batch.column(2):
            x = v.values
            ok = v.is_valid and len(x) > 0 and x.null_count == 0
            x = x.to_numpy(zero_copy_only=False).astype(np.float64) if ok else np.zeros(1)
            # by the largest component first, so that the squares of huge and tiny vectors stay in range
            top = float(np.abs(x).max()) if np.isfinite(x).all() else 0.0
            x = x / top if top > 0 else x
            size = math.sqrt(float(x @ x)) if top > 0 else 0.0
            keep.append(size > 0 and math.isfinite(size))
            body.append((x / size).tobytes() if keep[-1] else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(body, pa.binary())], ["id", "label", "v"]).filter(pa.array(keep, pa.bool_()))


def _leaves(batches: Iterator[pa.RecordBatch], seed: int, bits: dict[str, int]) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    most = max(bits.values(), default=0)
    for batch in batches:
        leaf = []
        for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x = np.frombuffer(v)
            if len(x) not in planes:
                planes[len(x)] = np.random.default_rng((seed, len(x))).normal(size=(most, len(x)))
            own = bits.get(label, 0)
            leaf.append(int(((planes[len(x)][:own] @ x > 0) * (1 << np.arange(own))).sum()) * 100_003 + len(x))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], ["id", "label", "v", "leaf"])


def _by_group(batches: Iterator[pa.RecordBatch], keys: int, work: Callable) -> Iterator[pa.RecordBatch]:
    """Calls work with the rows of each run of equal first columns."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[-1][:keys] != row[:keys]:
                yield from work(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from work(rows)


def _edges(rows: list[tuple], least: float, k: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Edges from each vector of a leaf to the first of those it is connected with."""
    n = len(rows)
    if n < 2:
        return
    x = np.stack([np.frombuffer(r[4]) for r in rows])
    near, far = nn_descent(x.astype(np.float32), k, np.random.default_rng(seed), least)
    i, j = np.nonzero(far >= least - 1e-4)
    j = near[i, j]
    ok = np.einsum("nd,nd->n", x[i], x[j]) >= least
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in zip(i[ok].tolist(), j[ok].tolist()):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    root = np.array([find(a) for a in range(n)])
    # a list full of neighbours within the threshold may leave some out: its vector is compared with the whole leaf
    full = np.flatnonzero(far.min(1) >= least - 1e-4) if far.shape[1] < n - 1 else np.arange(0)
    for lo in range(0, len(full), 256):
        hit = x[full[lo : lo + 256]] @ x.T >= least
        hit[np.arange(len(hit)), full[lo : lo + 256]] = True
        for row in hit:
            linked = np.unique(root[row])
            if len(linked) > 1:
                root[np.isin(root, linked)] = linked[0]
    tied = [(rows[a][3], rows[r][3]) for a, r in enumerate(root.tolist()) if r != a]
    if tied:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in tied], pa.int64()), pa.array([b for _, b in tied], pa.int64())], ["a", "b"])


def _crossed(rows: list[tuple], least: float) -> Iterator[pa.RecordBatch]:
    """Edges of a cell (two chunks of a group, or one with itself), by comparing all."""
    x = np.stack([np.frombuffer(r[5]) for r in rows])
    ids, chunk = [r[4] for r in rows], np.array([r[6] for r in rows])
    lo, hi = divmod(rows[0][3], CELLS)
    one, two = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
    root = np.arange(len(rows))
    for a in range(0, len(one), 256):
        own = one[a : a + 256]
        for i, row in zip(own, x[own] @ x[two].T >= least):
            linked = np.unique(root[np.append(two[row], i)])
            if len(linked) > 1:
                root[np.isin(root, linked)] = linked[0]
    tied = [(ids[a], ids[r]) for a, r in enumerate(root.tolist()) if r != a]
    if tied:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in tied], pa.int64()), pa.array([b for _, b in tied], pa.int64())], ["a", "b"])


def _counts(rows: list[tuple], least: float) -> Iterator[pa.RecordBatch]:
    """Links of each vector of a cell, to rows and to vectors other than itself."""
    x = np.stack([np.frombuffer(r[5]) for r in rows])
    rep, chunk, m = [r[4] for r in rows], np.array([r[6] for r in rows]), np.array([r[7] for r in rows], np.int64)
    lo, hi = divmod(rows[0][3], CELLS)
    total, others = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    parts = [np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)]
    for a in range(0, len(parts[0]), 512):
        own = parts[0][a : a + 512]
        hit = x[own] @ x[parts[1]].T >= least
        if lo == hi:
            hit[np.arange(len(own)), np.arange(a, a + len(own))] = False
        total[own] += hit @ m[parts[1]]
        others[own] += hit.sum(1)
        if lo != hi:
            total[parts[1]] += m[own] @ hit
            others[parts[1]] += hit.sum(0)
    if lo == hi:
        total[parts[0]] += m[parts[0]] - 1
    yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(total), pa.array(others)], ["rep", "n", "others"])


def _audit(batches: Iterator[pa.RecordBatch], asked: list[tuple[int, str, bytes]], least: float) -> Iterator[pa.RecordBatch]:
    """For each audited vector, the vectors it links with in this task's rows by comparing all, itself left out."""
    by: dict[tuple, tuple[list[int], np.ndarray]] = {}
    for q, label, v in asked:
        by.setdefault((label, len(v)), ([], []))[0].append(q)
        by[(label, len(v))][1].append(np.frombuffer(v))
    found: dict[int, int] = {}
    for batch in batches:
        groups: dict[tuple, list[tuple[int, bytes]]] = {}
        for rep, label, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
            groups.setdefault((label, len(v)), []).append((rep, v))
        for key, own in groups.items():
            if key in by:
                hit = np.stack(by[key][1]) @ np.stack([np.frombuffer(v) for _, v in own]).T >= least
                hit &= np.array(by[key][0])[:, None] != np.array([r for r, _ in own])
                for q, n in zip(by[key][0], hit.sum(1).tolist()):
                    found[q] = found.get(q, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["rep", "n"])


def _rounds(bits: int, least: float, recall: float) -> int:
    """Rounds after which a pair at the threshold has shared a leaf of so many hyperplanes with probability `recall`."""
    met = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return max(ROUNDS, math.ceil(math.log(max(1e-9, 1 - recall)) / math.log1p(-met))) if met < 1 else ROUNDS


def _cells(spark: SparkSession, rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (…three columns `by`, id, v, m) dealt to cells: groups are cut in chunks of CHUNK and each two chunks meet."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("held"))
    chunks = F.ceil(F.col("held") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("id"), chunks).cast("int")
    cells = F.array_distinct(F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.least(own, c) * F.lit(CELLS).cast("long") + F.greatest(own, c)))
    spread = rows.join(sizes, by).select(*by, F.explode(cells).alias("cell"), "id", "v", own.alias("chunk"), "m")
    return spread.repartition(width(spark), *by, "cell").sortWithinPartitions(*by, "cell", "id")


def links(spark: SparkSession, df: DataFrame, least: float = 0.93, k: int = 16, recall: float = 0.995, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) of every row; the last is the same for all: the share of the
    audited vectors' links that were found.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    unit = staged(spark, rows.filter("id is not null and label is not null and v is not null").mapInArrow(_unit, "id long, label string, v binary"))
    same = unit.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    reps = staged(spark, same.select(F.monotonically_increasing_id().alias("rep"), "label", "v", "id", "m"))
    member = staged(spark, unit.join(reps.select("label", "v", "rep", F.col("id").alias("first")), ["label", "v"]).select("id", "rep", "first"))
    large = reps.groupBy("label").count().filter(F.col("count") > LEAF).collect()
    bits = {r["label"]: math.ceil(math.log2(r["count"] / LEAF)) for r in large}
    most = max(MOST_ROUNDS, _rounds(max(bits.values(), default=0), least, recall))
    asked = [(r["rep"], r["label"], bytes(r["v"])) for r in reps.orderBy(F.xxhash64("v", "label"), "rep").limit(AUDITED).collect()]
    true = {r["rep"]: r["n"] for r in reps.select("rep", "label", "v").mapInArrow(lambda it: _audit(it, asked, least), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).filter("n > 0").collect()}
    sample = spark.createDataFrame([(q,) for q in true] or [(-1,)], "rep long")
    edges = member.filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    nodes = reps.select("id", "label", "v")
    # a round beyond those that a label's size asks for is there for labels that ask for more, or after an audit
    first = _rounds(max(bits.values(), default=0), least, recall)
    for t in range(most + 1):
        if t < most:
            asking = [label for label, b in bits.items() if t < _rounds(b, least, recall)]
            dealt = nodes if t < ROUNDS or t >= first else nodes.filter(F.col("label").isin(asking))
            leaved = dealt.mapInArrow(lambda it, t=t: _leaves(it, t, bits), "id long, label string, v binary, leaf long")
            leaved = leaved.withColumn("size", F.octet_length("v")).withColumn("m", F.lit(1))
            long = leaved.groupBy("label", "leaf", "size").agg(F.count("*").alias("n")).filter(F.col("n") > LONG_LEAF)
            short = leaved.join(long, ["label", "leaf", "size"], "left_anti").select("label", "leaf", "size", "id", "v")
            short = short.repartition(width(spark), "label", "leaf", "size").sortWithinPartitions("label", "leaf", "size", "id")
            new = staged(spark, short.mapInArrow(lambda it, t=t: _by_group(it, 3, lambda g: _edges(g, least, k, t)), "a long, b long"))
            edges = edges.union(new)
            wide = leaved.join(long, ["label", "leaf", "size"], "left_semi")
        else:
            # still short after the last round: all vectors of a label
            wide = nodes.select("label", F.lit(0).alias("leaf"), F.octet_length("v").alias("size"), "id", "v", F.lit(1).alias("m"))
        if t == most or long.limit(1).count():
            edges = edges.union(staged(spark, _cells(spark, wide, ["label", "leaf", "size"]).mapInArrow(lambda it: _by_group(it, 4, lambda g: _crossed(g, least)), "a long, b long")))
        if t < most and (t + 1 < first or (t - first) % 2 == 0 and t >= first and t + 1 < most):
            continue
        found = components(spark, edges)
        inside = reps.join(found, "id").select("component", "label", F.octet_length("v").alias("size"), F.col("rep").alias("id"), "v", "m")
        counts = staged(spark, _cells(spark, inside, ["component", "label", "size"]).mapInArrow(lambda it: _by_group(it, 4, lambda g: _counts(g, least)), "rep long, n long, others long").groupBy("rep").agg(F.sum("n").alias("n"), F.sum("others").alias("others")))
        got = {r["rep"]: r["others"] for r in counts.join(F.broadcast(sample), "rep").collect()}
        reached = sum(min(got.get(q, 0), n) / n for q, n in true.items()) / len(true) if true else 1.0
        if reached >= recall:
            break
    links_of = member.join(counts, "rep").groupBy("id").agg(F.sum("n").alias("n_links"))
    out = df.select(F.col(id_col).cast("long").alias("vec_id")).join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(links_of.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), F.lit(1.0 if t == most else reached).alias("audited_recall"))
