"""Best-fit packing: documents as token sequences of bounded length, with as little room wasted as can be.

Bounded-space online best-fit: a task keeps a fixed number of open bins in a bitset keyed by free space. A piece
goes to the open bin with the least room that still holds it; if there is none a bin is opened, and when too many
are open the fullest closes first. What a task leaves open meets that of other tasks in a second round.

Defined cases: a null text is an empty one (one end id); repeated rows are packed each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingsmith.llm._spark import shuffled, staged
from lingsmith.llm._tokens import byte_tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long, bin long, offset long, open boolean"


class OpenBins:
    """At most `most` open bins, found by free space through a bitset.

    >>> bins = OpenBins(10, 2)
    >>> [bins.put(n) for n in (6, 7, 3)]
    [(0, 0), (1, 0), (1, 7)]
    """

    def __init__(self, size: int, most: int):
        self.size, self.most, self.opened, self.count = size, most, 0, 0
        self.free = 0  # bit f: an open bin with f free
        self.bins: list[deque[int]] = [deque() for _ in range(size + 1)]

    def _hold(self, bin: int, room: int) -> None:
        if room:
            self.bins[room].append(bin)
            self.free |= 1 << room
            self.count += 1

    def _take(self, room: int) -> int:
        bin = self.bins[room].popleft()
        if not self.bins[room]:
            self.free &= ~(1 << room)
        self.count -= 1
        return bin

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece; a full bin is closed at once."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bin = self._take(room)
        else:
            if length < self.size and self.count >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest
            bin, room, self.opened = self.opened, self.size, self.opened + 1
        self._hold(bin, room - length)
        return bin, self.size - room

    def open(self) -> dict[int, int]:
        """What is used of each bin that is still open."""
        return {bin: self.size - room for room, held in enumerate(self.bins) for bin in held}


def pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than size."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def _packed(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    tokens, bins, shard = byte_tokens(path), OpenBins(size, most), TaskContext.get().partitionId()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "bin", "offset", "open"]
    held: dict[int, list] = {}

    def out(rows):
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    rows = []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.array([*tokens.encode(text.as_py() or ""), end_id], "<u4")
            for k, (start, length) in enumerate(pieces(len(ids), size)):
                bin, offset = bins.put(length)
                rows.append((doc, k, start, length, zlib.crc32(memoryview(ids[start : start + length])), shard, bin, offset))
        # only what stands in open bins is kept back
        still, done = bins.open(), []
        for row in rows:
            if row[6] in still:
                held.setdefault(row[6], []).append(row)
            else:
                done += [(*x, False) for x in held.pop(row[6], ())]
                done.append((*row, False))
        for bin in [x for x in held if x not in still]:
            done += [(*x, False) for x in held.pop(bin)]
        rows = []
        for i in range(0, len(done), 50_000):
            yield out(done[i : i + 50_000])
    if held:
        yield out([(*x, True) for own in held.values() for x in own])


def _repacked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Open bins of many tasks, packed into common ones, as many open as there are lengths."""
    part, bins = TaskContext.get().partitionId(), OpenBins(size, 1 << 40)
    for batch in batches:
        shard, bin, used = (batch.column(i).to_pylist() for i in range(3))
        to = [bins.put(n) for n in used]
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(bin, pa.int64()), pa.array([-1 - part] * len(to), pa.int64()), pa.array([b for b, _ in to], pa.int64()), pa.array([o for _, o in to], pa.int64())], ["shard", "bin", "new_shard", "new_bin", "more"])


def pack(spark: SparkSession, df: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, open_bins: int = 1024, id_col: str = "doc_id", text_col: str = "text", bins_a_task: int = 65_536) -> DataFrame:
    """Packs every whole text; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are encoded where they are read and never shuffled; only rows of pieces are written. The second round
    packs the bins that tasks left open (at most open_bins each), bins_a_task or so in a task, longest first.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = staged(spark, rows.mapInArrow(lambda it: _packed(it, tokenizer_path, size, end_id, open_bins), PIECES))
    opened = staged(spark, first.filter("open").groupBy("shard", "bin").agg(F.sum("length").alias("used")))
    tasks = max(1, -(-opened.count() // bins_a_task))
    order = [F.col("used").desc(), "shard", "bin"]
    again = staged(spark, opened.repartitionById(tasks, F.pmod(F.xxhash64("shard", "bin"), F.lit(tasks)).cast("int")).sortWithinPartitions(*order).mapInArrow(lambda it: _repacked(it, size), "shard long, bin long, new_shard long, new_bin long, more long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    moved = first.filter("open").join(shuffled(again), ["shard", "bin"]).select(*columns, _sequence("new_shard", "new_bin"), (F.col("offset") + F.col("more")).alias("offset"))
    return first.filter("not open").select(*columns, _sequence("shard", "bin"), "offset").union(moved)


def _sequence(shard: str, bin: str):
    return (F.col(shard) * F.lit(2**36) + F.col(bin)).alias("sequence_id")
