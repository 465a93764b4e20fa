"""Helpers shared by the operators: staged tables, id ranges, connected components."""

from __future__ import annotations

import gc
import math
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A Python worker collects its garbage after every task, however few rows that has: what imports made (some 29 ms each
# time) is left out of it.
if "pyspark.worker" in sys.modules:
    gc.freeze()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir). Where it is unset, a local session takes a temporary one; on
    a cluster that would be a different folder on each machine, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        found = tempfile.mkdtemp(prefix="lingsmith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by shuffle and merge, never by broadcast: for sides that grow with the input. Spark sizes a staged
    table by its compressed files and an array that is exploded as one element, so it would collect on the driver what is
    many times larger than its limit for broadcasts."""
    return df.hint("merge")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_bounds(df: DataFrame, column: str, rows_a_bucket: int = 4096, most: int = 20_000) -> list[int]:
    """Ascending split points of an integer column, about rows_a_bucket rows apart and at most `most` of them.

    Only this column is scanned. They bound the driver's memory: they don't grow beyond `most`.
    """
    n = df.select(column).count()
    k = min(most, math.ceil(n / rows_a_bucket))
    if k < 2:
        return []
    cuts = df.approxQuantile(column, [i / k for i in range(1, k)], max(1e-5, 1 / (8 * k)))
    return sorted({int(x) for x in cuts})


def buckets(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, ids, side="right").astype(np.int32)


def _forest(batches):
    """Contracts the edges of a task to a spanning forest of stars around the smallest ids."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush():
        rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
        parent.clear()
        for i in range(0, len(rows), 100_000):
            part = rows[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in part], pa.int64()), "b": pa.array([y for _, y in part], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 1_000_000:
            yield from flush()
    yield from flush()


def _ends(batches):
    """Edges of a forest at both their ends: (a, b, False), and (b, null, True) as b holds others."""
    for batch in _forest(batches):
        a, b = batch.columns
        n = len(a)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([b, pa.nulls(n, pa.int64())]), pa.array(np.arange(2 * n) >= n)], ["a", "b", "holds"])


def _told(batches):
    """Each edge at both its ends: (key, other, whether the other is the smaller)."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.arange(2 * len(a)) < len(a))], ["key", "other", "up"])


def _jumped(batches):
    """Edges, each moved from its smaller end to the smallest that this end has an edge to; a row of nulls if not all
    edges were stars around their smallest ids before."""
    rows = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]]
    for batch in batches:
        rows.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)])
    key, other, up = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((other[up], key[up]))
    child, parent = key[up][order], other[up][order]
    lead = np.append(True, child[1:] != child[:-1])[: len(child)]
    least, to = child[lead], parent[lead]
    top, low = key[~up], other[~up]
    at = np.minimum(np.searchsorted(least, top), max(len(least) - 1, 0))
    moved = least[at] == top if len(least) else np.zeros(len(top), bool)
    open_yet = moved.any() or (parent[1:] != parent[:-1])[~lead[1:]].any()
    new = np.where(moved, to[at], top) if len(least) else top
    for i in range(0, len(low), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(low[i : i + 100_000]), pa.array(new[i : i + 100_000])], ["a", "b"])
    if open_yet:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["a", "b"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (its first two columns); component is the smallest id reachable.

    Edges are contracted in each task first, so that a hub sends one row a task, and then in tasks that hold all
    edges of an id to smaller ones. Ids with one edge are set aside; the rest are contracted and moved to the
    smallest ids, until they are stars: the first time where they are read, as ids come whole there, and then with a shuffle
    for each of both, after a contraction where they are read. These rounds have no joins: the driver's memory grows with
    the number of shuffles, broadcasts and plans it has made, not only with what they hold. No task has two mapInArrow: each
    would take a Python worker of its own, and idle workers keep what earlier steps made them take.
    """
    a, b = edges.columns[:2]

    own = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    ends = own.mapInArrow(_forest, "a long, b long").repartition(width(spark), "a").mapInArrow(_ends, "a long, b long, holds boolean")
    nodes = staged(spark, ends.groupBy("a").agg(F.collect_set("b").alias("ups"), F.max("holds").alias("holds")).filter("size(ups) > 0"))
    leaf = (F.size("ups") == 1) & ~F.col("holds")
    leaves = nodes.filter(leaf).select("a", F.col("ups")[0].alias("b"))
    core, whole, held = nodes.filter(~leaf).select("a", F.explode("ups").alias("b")), True, []
    while True:
        met = core if whole else core.mapInArrow(_forest, "a long, b long").repartition(width(spark), "a")
        told = met.mapInArrow(lambda it: _told(_forest(it)), "key long, other long, up boolean")
        dealt = told.repartition(width(spark), "key")
        held.append(staged(spark, dealt.mapInArrow(_jumped, "a long, b long")))
        core, whole = held[-1].filter("a is not null"), False
        if not held[-1].filter("a is null").limit(1).count():
            break
    up = core.select(F.col("a").alias("b"), F.col("b").alias("c"))
    low = leaves.join(shuffled(up), "b", "left").select("a", F.coalesce("c", "b").alias("b")).union(core)
    out = staged(spark, low.union(low.select("b", "b")).toDF("id", "component").distinct())
    dropped(spark, nodes, *held)
    return out
