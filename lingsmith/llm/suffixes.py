"""Suffix-array dedup: bytes of repeated strings, by merging Burrows-Wheeler transforms of shards.

A string of `length` bytes that starts at two places, in one document or two, is repeated; every byte that one
covers is removed. Candidate regions are found first: by winnowing, each such string holds a content-chosen anchor,
so places of repeats share one. Regions around shared anchors are read as sequences of symbols of `length`/4 bytes.
A shard of regions is sorted and turned into its Burrows-Wheeler transform (the symbol before each suffix). The
transforms of the shards are merged by refining the interleave of their rows: a round reads the transforms in the
order so far and deals the rows out by symbol, which orders all suffixes by one symbol more; where the symbol or the
interval of before changes, an interval ends. After four rounds the intervals of several rows are the repeats.
Suffixes are never sorted across shards.

Documents of equal bytes are one text with several holders: of `length` bytes or more, all of it is removed.
Defined cases: a null text is empty; texts shorter than length lose nothing; each of repeated rows counts as a
document; matches never cross documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingsmith.llm._spark import staged, width
from lingsmith.llm._text import mix, powers

#: Bytes of an anchor; symbols of a repeated string; places of a shard; of a merge, about and at most.
ANCHOR, ROUNDS, SHARD, MERGED, MOST = 64, 4, 1 << 18, 1 << 20, 1 << 22


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place that has as many; never 0."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1]) | np.uint64(1)


def sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """Least or greatest (best: np.minimum, np.maximum) of each w values in a row."""
    n = len(x)
    pad = -n % w
    edge = np.iinfo(x.dtype).max if best is np.minimum else 0
    y = np.append(x, np.full(pad, edge, x.dtype)).reshape(-1, w)
    left = best.accumulate(y, 1).ravel()[:n]
    right = best.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()[:n]
    return best(right[: n - w + 1], left[w - 1 :])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: the least hash of each run that a string of length holds."""
    h = gram_hashes(data, ANCHOR)
    w = length - ANCHOR + 1
    if len(h) < w:
        return np.zeros(0, np.int64), h[:0]
    low = sliding(h, w, np.minimum)
    reach = sliding(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    at = np.flatnonzero(reach == h)
    h = h[at]
    if (h[1:] == h[:-1]).any():
        # of equal anchors in a row those go that lie between others less than a run apart: each run keeps one
        keep, kept = [], -(10**9)
        for i, p in enumerate(at.tolist()):
            if i + 1 < len(at) and h[i] == h[i + 1] and i and h[i] == h[i - 1] and int(at[i + 1]) - kept <= w:
                continue
            keep.append(i)
            kept = p
        at, h = at[keep], h[keep]
    return at, h


def region(at: int, n: int, length: int) -> tuple[int, int]:
    return max(0, at + ANCHOR - length), min(n, at + length)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())], ["doc_id", "n", "digest"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(t) for t in texts], pa.int64()), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([pack.compress(t) for t in texts], pa.binary())], ["n", "digest", "body"])


def _anchored(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(anchor, digest, at, context) of each text; context is a hash of the region."""
    for batch in batches:
        for digest, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = zstandard.decompress(body)
            data = np.frombuffer(text, np.uint8)
            at, h = anchors(data, length)
            if len(at):
                spans = [region(p, len(data), length) for p in at.tolist()]
                context = [xxhash.xxh3_64_intdigest(text[a:b], p - a) for p, (a, b) in zip(at.tolist(), spans)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([digest] * len(at), pa.binary()), pa.array(at, pa.int64()), pa.array(np.array(context, np.uint64).view(np.int64))], ["anchor", "digest", "at", "context"])


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the regions that are asked for."""
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for digest, body, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = zstandard.decompress(body)
            runs: list[list] = []
            for anchor, at in sorted((w["anchor"], w["at"]) for w in wanted):
                a, b = region(at, len(text), length)
                if runs and runs[-1][0] == anchor and a <= runs[-1][2]:
                    runs[-1][2] = b  # in a text that repeats itself an anchor comes again and again
                else:
                    runs.append([anchor, a, b])
            for anchor, a, b in runs:
                out.append((anchor, digest, a, text[a:b]))
                size += b - a
            if size > 8_000_000:
                yield _regions(out)
                out, size = [], 0
        if out:
            yield _regions(out)


def _regions(rows):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["anchor", "digest", "start", "text"])


def _ordered(x: np.ndarray) -> np.ndarray:
    """Stable order of integers below 2**32, by their halves: numpy sorts 16 bits by radix."""
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((x >> 16).astype(np.uint16)[low], kind="stable")] if len(x) and int(x.max()) >> 16 else low


class Shard:
    """The sorted suffixes of some regions, as symbol sequences, and their transform.

    sym: the symbol from each place (0 where too few bytes are left); step: places that a symbol takes.
    """

    def __init__(self, texts: list[bytes], step: int):
        self.sizes = np.array([len(t) + 1 for t in texts])  # with the place after the last byte
        data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        first = np.concatenate([[0], np.cumsum(self.sizes)])
        sym = np.zeros(len(data), np.uint64)
        left = np.repeat(first[1:] - 1, self.sizes) - np.arange(len(data))
        h = gram_hashes(data, step)
        ok = left >= step
        sym[ok] = h[np.flatnonzero(ok)]
        rank = np.unique(sym, return_inverse=True)[1].astype(np.int64)  # 0 for no symbol, if there is such a place
        rank += int(ok.all())
        order = np.arange(len(data))
        for r in range(ROUNDS - 1, -1, -1):
            key = np.zeros(len(data), np.int64)
            has = np.flatnonzero(left >= step * (r + 1))
            key[has] = rank[has + step * r]
            order = order[_ordered(key[order])]
        self.order = order
        into = np.arange(len(data)) - np.repeat(first[:-1], self.sizes)
        before = np.zeros(len(data), np.uint64)
        had = np.flatnonzero(into >= step)
        before[had] = sym[had - step]
        self.transform = before[self.order]
        # places with less than a symbol left end their sequences and are the first rows, in any order
        self.ends = int((~ok).sum())


def merged(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each row of the merged order, and whether a row shares its first ROUNDS symbols with a neighbour.

    A row that ends a sequence is in no interval.
    """
    sizes = np.array([len(s.order) for s in shards])
    ends = np.array([s.ends for s in shards])
    all_ends = int(ends.sum())
    kind = np.uint16 if len(shards) < 65536 else np.int64
    z = np.repeat(np.arange(len(shards)).astype(kind), sizes)
    interval = np.zeros(len(z), np.int64)
    symbols = np.concatenate([s.transform for s in shards])
    flow = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + int(symbols.all())
    for _ in range(ROUNDS):
        rows = np.argsort(z, kind="stable")  # the rows of the shards in turn
        symbol = np.empty(len(z), np.int64)
        symbol[rows] = flow
        back = np.flatnonzero(symbol)  # the other rows start a sequence: nothing stands before them
        deal = back[_ordered(symbol[back])]
        new = np.ones(len(deal), bool)
        new[1:] = (symbol[deal][1:] != symbol[deal][:-1]) | (interval[deal][1:] != interval[deal][:-1])
        z = np.concatenate([np.repeat(np.arange(len(shards)).astype(kind), ends), z[deal]])
        # each end is an interval of its own, so that sequences that have ended equal none
        interval = np.concatenate([np.arange(all_ends), all_ends + np.cumsum(new) - 1])
    same = np.zeros(len(z), bool)
    pair = interval[1:] == interval[:-1]
    same[1:] |= pair
    same[:-1] |= pair
    return z, same


def repeats(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the places at which a string of length starts that also starts elsewhere in these texts.

    Regions of one hot anchor may exceed what a merge can hold in memory; they are told by hashes of their strings,
    text after text.
    """
    if sum(map(len, texts)) > MOST:
        own = [gram_hashes(np.frombuffer(t, np.uint8), length) for t in texts]
        value, count = np.unique(np.concatenate(own), return_counts=True)
        twice = value[count > 1]
        return [np.flatnonzero(np.isin(h, twice)) for h in own]
    step = length // ROUNDS
    shards, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SHARD:
            shards.append(Shard(held, step))
            held, size = [], 0
    if held:
        shards.append(Shard(held, step))
    z, same = merged(shards)
    out = []
    for k, s in enumerate(shards):
        flag = np.zeros(len(s.order), bool)
        flag[s.order] = same[z == k]
        first = np.concatenate([[0], np.cumsum(s.sizes)])
        out += [np.flatnonzero(flag[a:b]) for a, b in zip(first, first[1:])]
    return out


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of bytes that strings from these places cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def _matched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Removed runs from regions that come by anchor; a merge takes whole anchors."""
    rows: list[tuple] = []
    size = 0

    def work():
        seen: dict[tuple, None] = {}
        for anchor, digest, start, text in rows:
            seen[(digest, start, text)] = None
        # regions of one text that overlap are one, or a place would match itself
        own: dict[bytes, list] = {}
        for digest, start, text in seen:
            own.setdefault(digest, []).append((start, text))
        joined: list[tuple[bytes, int, bytes]] = []
        for digest, parts in own.items():
            parts.sort(key=lambda p: (p[0], len(p[1])))
            at, text = parts[0]
            for start, more in parts[1:]:
                if start <= at + len(text):
                    text += more[at + len(text) - start :] if start + len(more) > at + len(text) else b""
                else:
                    joined.append((digest, at, text))
                    at, text = start, more
            joined.append((digest, at, text))
        found = [(d, at + a, at + b) for (d, at, _), starts in zip(joined, repeats([t for _, _, t in joined], length)) for a, b in _spans(starts, length)]
        if found:
            cols = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["digest", "lo", "hi"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if size >= MERGED and rows[-1][0] != row[0]:
                yield from work()
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield from work()


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for digest, body, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = zstandard.decompress(body)
            at, gone, runs, kept = 0, 0, [], hashlib.sha256()
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(hi, runs[-1][1])
                else:
                    runs.append([lo, hi])
            for lo, hi in runs:
                kept.update(text[at:lo])
                gone, at = gone + hi - lo, hi
            kept.update(text[at:])
            out.append((digest, gone, len(runs), kept.hexdigest()))
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["digest", "n_removed", "n_spans", "kept_sha256"])


def dedup(spark: SparkSession, df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = staged(spark, rows.mapInArrow(_named, "doc_id long, n long, digest binary"))
    texts = staged(spark, rows.mapInArrow(_packed, "n long, digest binary, body binary").groupBy("digest").agg(F.min("body").alias("body"), F.count("*").alias("copies"), F.first("n").alias("n")))
    places = texts.filter(F.col("n") >= length).select("digest", "body").mapInArrow(lambda it: _anchored(it, length), "anchor long, digest binary, at long, context long")
    # equal regions are one, with the first holder to stand for them; regions without a partner go
    places = staged(spark, places)
    same = places.groupBy("anchor", "context").agg(F.count("*").alias("m"), F.min(F.struct("digest", "at")).alias("who"))
    placed = staged(spark, same)
    shared = placed.groupBy("anchor").agg(F.count("*").alias("regions")).filter("regions > 1").select("anchor")
    once = placed.join(shared, "anchor", "left_semi").select("anchor", "who.digest", "who.at")
    wanted = once.groupBy("digest").agg(F.collect_list(F.struct("anchor", "at")).alias("wanted"))
    cut = texts.join(wanted, "digest").select("digest", "body", "wanted").mapInArrow(lambda it: _cut_out(it, length), "anchor long, digest binary, start long, text binary")
    dealt = cut.repartition(width(spark), "anchor").sortWithinPartitions("anchor", "digest", "start")
    found = dealt.mapInArrow(lambda it: _matched(it, length), "digest binary, lo long, hi long")
    # every holder of a region with several holders loses what the region's strings cover
    several = placed.filter("m > 1").select("anchor", "context")
    held = places.join(several, ["anchor", "context"], "left_semi").join(texts.select("digest", "n"), "digest")
    lo, hi = F.greatest(F.lit(0), F.col("at") + ANCHOR - length), F.least(F.col("n"), F.col("at") + length)
    whole = held.filter(hi - lo >= length).select("digest", lo.alias("lo"), hi.alias("hi"))
    copied = texts.filter((F.col("copies") > 1) & (F.col("n") >= length)).select("digest", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))
    spans = found.union(whole).union(copied).distinct().groupBy("digest").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    out = texts.join(spans, "digest", "left").select("digest", "body", "spans").mapInArrow(_result, "digest binary, n_removed long, n_spans long, kept_sha256 string")
    return docs.select("doc_id", "n", "digest").join(out, "digest").select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
