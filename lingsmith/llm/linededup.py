"""Line dedup by pairwise alignment.

Documents overlap where they share a run of adjoining lines, blank ones aside: the shortest run from a line that has
LEAST bytes, and the shortest of two lines or more that has. Any common block of LEAST bytes holds such a run. A run
of RARE holders at most pairs all of them; a commoner one pairs each holder with the earliest, so a line that a third of
all documents hold gives most of them one partner. Each pair is aligned by patience diff, stretches without a line
unique on both sides by a longest common subsequence, and the aligned common blocks of LEAST bytes or more are deleted
from the later document.

Documents are ordered by id (null first), then by a hash of their text. Defined cases: null and empty texts stay as
they are, and so do texts with less than LEAST bytes; rows with the same id and text are one document and keep the same
lines; blank lines are compared with nothing and go only with a whole document; an empty table gives no rows; other
columns are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingsmith.llm._spark import dropped, shuffled, staged

#: Bytes of a common block; holders of a run that all pair with each other; partners of a document in one task.
LEAST, RARE, FOLLOWERS = 10, 4, 1024


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ascending in both, of pairs that ascend in the first."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tops, b)
        back[k] = at[i - 1] if i else -1
        tops[i : i + 1], at[i : i + 1] = [b], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _longest(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a stretch without blank lines, by Hunt and Szymanski; chains share their starts."""
    places: dict[int, list[int]] = {}
    for j in range(b1 - 1, b0 - 1, -1):
        places.setdefault(b[j], []).append(j)
    tops: list[int] = []
    ends: list[tuple] = []
    for i in range(a0, a1):
        for j in places.get(a[i], ()) if a[i] else ():
            at = bisect_left(tops, j)
            if at == len(tops) or tops[at] != j:
                tops[at : at + 1], ends[at : at + 1] = [j], [(i, j, ends[at - 1] if at else None)]
    out, node = [], ends[-1] if ends else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines; 0 stands for a blank line, which aligns with nothing.

    >>> patience([1, 2, 3, 9], [2, 3, 3, 1, 9])
    [(1, 0), (2, 1), (3, 4)]
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(b[b0:b1], b0) if nb[x] == 1}
        chain = _increasing([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x and na[x] == 1 and x in place])
        if not chain:
            # no line is unique on both sides
            out += _longest(a, b, a0, a1, b0, b1)
            continue
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]):
            todo.append((i + 1, k, j + 1, m))
        out += chain
    return sorted({(i, j) for i, j in out if a[i]})


def line_hashes(text: str) -> np.ndarray:
    """64-bit hash of each line without blanks at its ends; 0 for a blank one."""
    return np.array([xxhash.xxh3_64_intdigest(s) | 1 if (s := x.strip()) else 0 for x in text.split("\n")], np.uint64)


def runs(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distinct hashes of the runs of lines (hashes, bytes; no blank ones) that pair documents."""
    n = len(h)
    before = np.concatenate([[0], np.cumsum(size)])
    # the line that ends the shortest run of LEAST bytes from each line
    end = np.searchsorted(before, before[:-1] + LEAST) - 1
    alone = end == np.arange(n)
    keys = set(h[alone].tolist())
    data = h.tobytes()
    for i in range(n):
        for last in {int(end[i]), max(int(end[i]), i + 1)}:
            if i < last < n:
                keys.add(xxhash.xxh3_64_intdigest(data[8 * i : 8 * last + 8]) & ~1)
    return np.fromiter(keys, np.uint64, len(keys))


LINED = "doc long, tie long, lines binary, sizes binary, keys array<long>"


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            lines, sizes, keys = [], [], []
            for text in part.column(2).to_pylist():
                h = line_hashes(text)
                size = np.array([min(LEAST, len(x.strip().encode())) for x in text.split("\n")], np.uint8)
                lines.append(h.tobytes())
                sizes.append(size.tobytes())
                keys.append(runs(h[h > 0], size[h > 0].astype(np.int64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lines, pa.binary()), pa.array(sizes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc", "tie", "lines", "sizes", "keys"])


def blocks(a: list[int], b: list[int], sizes: bytes, hit: list[tuple[int, int]]) -> list[int]:
    """Places in b of the aligned lines that stand in common blocks of LEAST bytes or more."""
    ra, rb = (np.cumsum(np.array(x, np.uint64) > 0).tolist() for x in (a, b))
    out: list[int] = []
    block: list[int] = []
    last = (-1, -1)
    for i, j in [*hit, (-1, -1)]:
        if block and (i < 0 or (ra[i], rb[j]) != (last[0] + 1, last[1] + 1)):
            if sum(sizes[k] for k in block) >= LEAST:
                out += block
            block = []
        if i >= 0:
            block.append(j)
            last = ra[i], rb[j]
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, ties, gone = [], [], []
        for doc, tie, later, sizes, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
            own, other = (np.frombuffer(x, np.uint64).tolist() for x in (later, first))
            cut = blocks(other, own, sizes, patience(other, own))
            if cut:
                docs.append(doc), ties.append(tie), gone.append(cut)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ties, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc", "tie", "gone"])


def _key(id_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("__doc"), F.xxhash64("text").alias("__tie")]


def repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(__doc, __tie, __gone): the places of the lines to delete from each document that repeats an earlier one."""
    rows = docs.filter("text is not null and text <> ''").select(*_key(id_col), "text")
    lined = staged(spark, rows.mapInArrow(_lined, LINED))
    held = lined.select(F.explode("keys").alias("key"), F.struct("doc", "tie").alias("who")).distinct()
    owners = held.groupBy("key").agg(F.min("who").alias("owner"), F.count("*").alias("holders")).filter("holders > 1")
    shared = staged(spark, held.join(shuffled(owners), "key").filter((F.col("who") != F.col("owner")) | (F.col("holders") <= RARE)))
    # the holders of a rare run, in order: every two of them
    few = shared.filter(F.col("holders").between(3, RARE)).groupBy("key").agg(F.sort_array(F.collect_list("who")).alias("all"))
    each = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", F.lit(1), i), lambda y: F.struct(x.alias("who"), y.alias("owner")))))
    pairs = shared.filter("who <> owner").select("who", "owner").union(few.select(F.explode(each).alias("p")).select("p.who", "p.owner"))
    pairs = staged(spark, pairs.distinct())
    # a document with many partners that come later is dealt to several tasks
    parts = pairs.groupBy("owner").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts")).filter("parts > 1")
    texts = lined.select(F.struct("doc", "tie").alias("who"), "lines", "sizes").dropDuplicates(["who"])
    dealt = pairs.join(parts, "owner", "left").select("who", "owner", F.pmod(F.xxhash64("who"), F.coalesce("parts", F.lit(1))).alias("part"))
    first = texts.select(F.col("who").alias("owner"), F.col("lines").alias("first")).join(parts, "owner", "left")
    first = first.select("owner", "first", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")).withColumn("part", F.col("part").cast("long"))
    both = dealt.withColumn("part", F.col("part").cast("long")).join(shuffled(texts), "who").join(shuffled(first), ["owner", "part"])
    gone = staged(spark, both.select("who.doc", "who.tie", "lines", "sizes", "first").mapInArrow(_aligned, "doc long, tie long, gone array<int>"))
    dropped(spark, lined, shared, pairs)
    merged = gone.groupBy("doc", "tie").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return merged.select(F.col("doc").alias("__doc"), F.col("tie").alias("__tie"), F.col("gone").alias("__gone"))


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the repeated lines cut from text, and n_lines and n_removed beside its columns.

    A document that loses all its lines has an empty text. Places of lines are counted from 0.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = repeated_lines(spark, docs, id_col)
    joined = docs.select(*kept, *_key(id_col)).join(shuffled(gone), ["__doc", "__tie"], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    left = F.filter(F.col("__lines"), lambda x, i: ~F.array_contains("__gone", i))
    whole = F.forall(left, lambda x: F.trim(x) == "")
    text = F.when(F.col("__gone").isNull(), F.col("text")).when(whole, F.lit("")).otherwise(F.array_join(left, "\n")).alias("text")
    counts = [F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed")]
    return joined.withColumn("__lines", lines).select(*[text if c == "text" else F.col(c) for c in kept], *counts)
