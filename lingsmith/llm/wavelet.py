"""Token-ID output: a wavelet matrix per shard of a corpus, in ascending document order.

A shard is one compressed file: the ids and lengths of a run of documents, and their token ids as bit-planes, from the
highest bit down; each plane is the stable partition of the one before by its bit. A plane has a directory of ranks by
block and is packed in frames, so that access to a token, counts of an id and the place of its k-th occurrence unpack
the frames they touch only.

Defined cases: a null text is empty and has only the end id; rows with equal ids keep their order by text; rows
with a null id come first; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingsmith.llm._spark import buckets, id_bounds, staged
from lingsmith.llm._text import raw, slices
from lingsmith.llm._tokens import word_tokens

MAGIC = b"WVM2"
#: Magic, planes, ids, bytes of the table of documents.
HEAD = struct.Struct("<4sIQQ")
#: Bits between two stored ranks, and bytes of a frame.
BLOCK, FRAME = 512, 1 << 15
#: Ids of a shard before it is closed.
SHARD_IDS = 1 << 21


class Plane:
    """A bit-plane in packed frames with the set bits before each block.

    On disk: number of frames, zeros, the directory's size, the frames' sizes, the packed directory, the frames.
    """

    def __init__(self, n: int, zeros: int, ranks: np.ndarray, frames: list[bytes]):
        self.n, self.zeros, self.ranks, self.frames = n, zeros, ranks, frames
        self._open: dict[int, bytes] = {}

    @classmethod
    def of(cls, ones: np.ndarray) -> Plane:
        bits = np.packbits(ones, bitorder="little")
        count = np.bitwise_count(np.append(bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8))).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(count)]).astype("<u4")
        pack = zstandard.ZstdCompressor(level=1)
        data = bits.tobytes()
        return cls(len(ones), len(ones) - int(ranks[-1]), ranks, [pack.compress(data[i : i + FRAME]) for i in range(0, len(data), FRAME)])

    def to_bytes(self) -> bytes:
        ranks = zstandard.compress(np.diff(self.ranks).astype("<u2").tobytes(), 1)
        sizes = [len(self.frames), self.zeros, len(ranks), *map(len, self.frames)]
        return struct.pack(f"<{len(sizes)}Q", *sizes) + ranks + b"".join(self.frames)

    @classmethod
    def read(cls, data: bytes, at: int, n: int) -> tuple[Plane, int]:
        k, zeros, size = struct.unpack_from("<3Q", data, at)
        sizes = struct.unpack_from(f"<{k}Q", data, at + 24)
        at += 24 + 8 * k
        ranks = np.concatenate([[0], np.cumsum(np.frombuffer(zstandard.decompress(data[at : at + size]), "<u2"))])
        at += size
        frames = []
        for size in sizes:
            frames.append(data[at : at + size])
            at += size
        return cls(n, zeros, ranks, frames), at

    def _frame(self, k: int) -> bytes:
        if k not in self._open:
            self._open[k] = zstandard.decompress(self.frames[k])
        return self._open[k]

    def bits(self) -> np.ndarray:
        data = b"".join(map(zstandard.decompress, self.frames))
        return np.unpackbits(np.frombuffer(data, np.uint8), count=self.n, bitorder="little").view(bool)

    def bit(self, i: int) -> int:
        return self._frame(i // 8 // FRAME)[i // 8 % FRAME] >> (i % 8) & 1

    def ones(self, i: int) -> int:
        """Set bits before place i."""
        block, rest = divmod(i, BLOCK)
        out = int(self.ranks[block])
        if rest:
            at = block * BLOCK // 8
            data = self._frame(at // FRAME)[at % FRAME : at % FRAME + BLOCK // 8]
            out += (int.from_bytes(data, "little") & ((1 << rest) - 1)).bit_count()
        return out


class WaveletMatrix:
    """A sequence of ids as succinct bit-planes with rank and select.

    >>> w = WaveletMatrix.of(np.array([3, 1, 3, 0], np.uint32))
    >>> w.access(2), w.rank(3, 4), w.select(3, 1), w.count(1)
    (3, 2, 2, 1)
    """

    def __init__(self, n: int, planes: list[Plane], documents: bytes = b""):
        self.n, self.planes, self.documents = n, planes, documents

    @classmethod
    def of(cls, ids: np.ndarray, documents: bytes = b"") -> WaveletMatrix:
        """documents: a table of the documents whose ids these are, kept as it is."""
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32, copy=False)
        planes = []
        for bit in range(bits - 1, -1, -1):
            one = (now >> now.dtype.type(bit)) & now.dtype.type(1) != 0
            planes.append(Plane.of(one))
            now = np.concatenate([now.take(np.flatnonzero(~one)), now.take(np.flatnonzero(one))])  # masks of mixed bits cost twice as much
        return cls(len(ids), planes, documents)

    def to_bytes(self) -> bytes:
        packed = zstandard.compress(self.documents, 1)
        return HEAD.pack(MAGIC, len(self.planes), self.n, len(packed)) + packed + b"".join(p.to_bytes() for p in self.planes)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, n, size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = HEAD.size + size
        documents, planes = zstandard.decompress(data[HEAD.size : at]), []
        for _ in range(bits):
            plane, at = Plane.read(data, at, n)
            planes.append(plane)
        return cls(n, planes, documents)

    def ids(self) -> np.ndarray:
        """The whole sequence: each plane undoes one partition, from the lowest up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for shift, plane in enumerate(reversed(self.planes)):
            one = plane.bits()
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~one)] = now[: plane.zeros]
            up[np.flatnonzero(one)] = now[plane.zeros :] | kind(1 << shift)
            now = up
        return now.astype(np.uint32)

    def access(self, i: int) -> int:
        out = 0
        for plane in self.planes:
            bit, ones = plane.bit(i), plane.ones(i)
            i = plane.zeros + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where occurrences of symbol before place i stand below the lowest plane."""
        lo, hi = 0, i
        if symbol >> len(self.planes):
            return 0, 0
        for shift, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes):
            a, b = plane.ones(lo), plane.ones(hi)
            lo, hi = (plane.zeros + a, plane.zeros + b) if symbol >> shift & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of symbol before place i."""
        lo, hi = self._range(symbol, i)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th occurrence (from 0), or -1."""
        lo, hi = self._range(symbol, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for shift, plane in enumerate(reversed(self.planes)):
            one = symbol >> shift & 1
            want = i - plane.zeros if one else i
            a, b = 0, self.n  # the smallest prefix that holds want + 1 such bits
            while a < b:
                m = (a + b) // 2
                ones = plane.ones(m + 1)
                if (ones if one else m + 1 - ones) > want:
                    b = m
                else:
                    a = m + 1
            i = a
        return i


SHARDS = "bucket int, shard int, n_ids long, wavelet binary"


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    tokens, pack = word_tokens(path), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, off = raw(batch.column(1))
        ids = batch.column(0)
        at = buckets(ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), bounds)
        for i, j in slices(off, 1 << 22):
            found = [np.append(x, tokens.kind(end_id)) for x in tokens.encode_all(data[off[i] : off[j]], off[i : j + 1] - off[i])]
            out = [pack.compress(x.tobytes() if x.itemsize == 2 else b"\0" + x.tobytes()) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(at[i:j]), ids[i:j], pa.array(out, pa.binary())], ["bucket", "doc_id", "ids"])


def _unpacked(data: bytes) -> np.ndarray:
    data = zstandard.decompress(data)
    return np.frombuffer(data[1:], np.uint32) if len(data) % 2 else np.frombuffer(data, np.uint16)


def _shards(batches: Iterator[pa.RecordBatch], shard_ids: int) -> Iterator[pa.RecordBatch]:
    """Shards from documents that come in order, bucket by bucket."""
    docs: list[int | None] = []
    parts: list[np.ndarray] = []
    bucket, shard, size = None, 0, 0

    def close():
        nonlocal docs, parts, size
        lengths = np.array([len(x) for x in parts], np.int64)
        names = np.array([-(2**63) if x is None else x for x in docs], "<i8")
        blob = WaveletMatrix.of(np.concatenate(parts), names.tobytes() + lengths.astype("<i8").tobytes()).to_bytes()
        out = pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([shard], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "shard", "n_ids", "wavelet"])
        docs, parts, size = [], [], 0
        return out

    for batch in batches:
        for now, doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if now != bucket or size >= shard_ids:
                if docs:
                    yield close()
                shard = shard + 1 if now == bucket else 0
                bucket = now
            found = _unpacked(data.as_py())
            docs.append(doc)
            parts.append(found)
            size += len(found)
    if docs:
        yield close()


def write_shards(spark: SparkSession, df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every whole text, appends end_id and writes wavelet shards in ascending id order; returns the shard table.

    Ids and not texts are shuffled, once, to ranges of document ids found from the id column alone. A shard is
    closed at shard_ids ids (a document is never cut), so memory does not grow with a range. Each row of the table,
    which is in the shared folder, holds one shard file: document ids, their lengths, and the compressed matrix.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = np.array(id_bounds(rows, "doc_id"), np.int64)
    found = rows.mapInArrow(lambda it: _encoded(it, tokenizer_path, end_id, bounds), "bucket int, doc_id long, ids binary")
    dealt = found.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    return staged(spark, dealt.mapInArrow(lambda it: _shards(it, shard_ids), SHARDS))


def _read(batches: Iterator[pa.RecordBatch], before: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            matrix = WaveletMatrix.from_bytes(row["wavelet"])
            ids = matrix.ids().astype("<u4")
            docs, lengths = np.frombuffer(matrix.documents, "<i8").reshape(2, -1)
            at = np.concatenate([[0], np.cumsum(lengths)])
            sums = [zlib.crc32(memoryview(ids[a:b])) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == -(2**63)), pa.array(before[row["bucket"]] + row["before"] + at[:-1]), pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards.

    Ids before a shard: a sum over the shards of its range, plus the total of the ranges before it; only these
    totals, at most 20,000, come to the driver.
    """
    from pyspark.sql import Window

    totals = sorted((r["bucket"], r["n"]) for r in shards.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect())
    before, run = {}, 0
    for bucket, n in totals:
        before[bucket] = run
        run += n
    order = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    small = shards.select("bucket", "shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    rows = shards.join(small, ["bucket", "shard"]).select("bucket", "before", "wavelet")
    return rows.mapInArrow(lambda it: _read(it, before), "doc_id long, start long, n_tokens long, ids_crc32 long")
