"""N-gram Jaccard join by set-relation skipping.

Sets of word 3-grams link when their Jaccard similarity reaches the threshold. Equal sets are one set. Highly similar
sets are found first: sets that share one of their LEAST least hashes are compared with their likeliest partner only, by
a sketch whose bound is exact. Then each set puts its rarest elements (as many as a partner must share one of) into
index lists. A list is read in blocks by size and position: blocks whose sizes or positions rule a link out are skipped
whole. Answers are derived from those of similar sets: lists whose members are all of one group are skipped, before and
after each member has been compared with its likeliest partner of another group; in the
others the distances from one member of a group to all others are computed, and those of the group's other members
follow from them by the triangle inequality where that rules a link out. Every pair that is left open is verified on the
texts. Links inside a group that its first pairs have joined are neither looked for nor counted.

The order of elements by rarity comes from counts in a table of fixed size; any order gives the same result.

Defined cases: a null, empty or blank text has the empty set and links with nothing; a text of fewer words than a
shingle is one element; rows with the same id, or with none, count as linked; a null id is the component of such rows
only where they link with no other; an empty table gives no rows; other columns are ignored or, by one_of_each, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingsmith.llm._spark import components, dropped, shuffled, staged, width
from lingsmith.llm._text import mix, raw, shingles, slices, words

#: Bits of the table of counts, and the blocks it travels in.
TABLE_BITS, TABLE_BLOCKS = 24, 64
#: Least bits of a sketch; one has at least half a bit for each element, in powers of two.
SKETCH_BITS = 512
#: Members of a list from which it is split into cells, and members of a chunk of it.
LONG_LIST, CHUNK = 4096, 2048
#: Members that are compared at once.
BLOCK = 256
#: Bits of the map that tells which texts are asked for, and of the blocks it travels in (those of Spark's bitmaps).
MARK_BITS, MARK_BLOCK_BITS = 24, 15
#: Hashes by which the first similar set is found; rows of an index list that are held until a second group shows up.
LEAST, HELD = 3, 100_000
#: An id that stands for null, after all others.
NO_ID = 2**63 - 1


def sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) of slices of an array."""
    data, off = raw(texts)
    for i, j in slices(off):
        h, row, _, _ = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        g, row = shingles(h, row, j - i, k)
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[new], row[new]
        cut = np.searchsorted(row, np.arange(j - i + 1))
        yield i, [g[a:b] for a, b in zip(cut, cut[1:])]


def sketch(s: np.ndarray) -> bytes:
    """Parity of the elements in each of some slots: two sketches differ in at most as many slots as the sets in
    elements. The wider of two folds to the narrower."""
    bits = SKETCH_BITS
    while bits < len(s) // 2:
        bits *= 2
    slot = (mix(s + np.uint64(77)) >> np.uint64(20)) % np.uint64(bits)
    return np.packbits(np.bincount(slot.astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of at least `size` bytes as rows of that many."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint64)
        while len(x) > size // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


FIRST = "id long, n long, key long, more long, body binary, sketch binary, least array<long>, block int"


def _first(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row a document with its set's digest (key, more), and for the first of equal sets in this task the packed text,
    a sketch and the least hashes; at the end, the counts of this task's elements."""
    pack = zstandard.ZstdCompressor(level=1)
    counts = np.zeros(1 << TABLE_BITS, np.uint32)
    names = ["id", "n", "key", "more", "body", "sketch", "least", "block"]
    seen: set[bytes] = set()
    for batch in batches:
        for first, found in sets(batch.column(1), k):
            if found:
                np.add.at(counts, (np.concatenate(found) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), 1)
            own = batch.slice(first, len(found))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            if len(seen) > 1_000_000:
                seen.clear()
            new = [len(s) > 0 and d not in seen and not seen.add(d) for s, d in zip(found, digests)]
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            texts = own.column(1).to_pylist()
            columns = [
                own.column(0),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array(pair[:, 0].copy()),
                pa.array(pair[:, 1].copy()),
                pa.array([pack.compress(t.encode()) if ok else None for t, ok in zip(texts, new)], pa.binary()),
                pa.array([sketch(s) if ok else None for s, ok in zip(found, new)], pa.binary()),
                pa.array([s[:LEAST].view(np.int64) if ok else None for s, ok in zip(found, new)], pa.list_(pa.int64())),
                pa.nulls(len(found), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
    if counts.any():
        parts = [pack.compress(x.tobytes()) for x in np.split(counts, TABLE_BLOCKS)]
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32()]
        columns = [pa.nulls(TABLE_BLOCKS, kind) for kind in kinds]
        columns[4], columns[7] = pa.array(parts, pa.binary()), pa.array(range(TABLE_BLOCKS), pa.int32())
        yield pa.RecordBatch.from_arrays(columns, names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zstandard.decompress(body), np.uint32).astype(np.uint64)
            total[block] = total[block] + x if block in total else x
    if total:
        kind = [np.minimum(255, np.ceil(4 * np.log2(x + 1.0))).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(kind, pa.binary())], ["block", "body"])


def rarity(first: DataFrame) -> np.ndarray:
    """The count of each slot of the table in 256 classes: 16 MB at every size of the input."""
    rows = first.filter("block is not null").select("block", "body").repartition(TABLE_BLOCKS, "block").mapInArrow(_summed, "block int, body binary").collect()
    out = np.zeros((TABLE_BLOCKS, (1 << TABLE_BITS) // TABLE_BLOCKS), np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["body"], np.uint8)
    return out.reshape(-1)


def prefix(s: np.ndarray, table: np.ndarray, percent: int) -> np.ndarray:
    """The rarest elements of a set, of which any partner shares one, in the order of rarity."""
    p = len(s) - -(-percent * len(s) // 100) + 1
    kind = table[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    return s[np.lexsort((s, kind))[:p]]


def _prefixes(batches: Iterator[pa.RecordBatch], table, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(key, id, n, tokens) of texts: the prefix of each set, in the order of rarity."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = pa.array([zstandard.decompress(x) for x in part.column(2).to_pylist()], pa.binary())
            n, tokens = [], []
            for _, found in sets(texts, k):
                n += [len(s) for s in found]
                tokens += [prefix(s, table.value, percent).tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(tokens, pa.binary())], ["key", "id", "n", "tokens"])


POSTED = "token long, size int, pos int, key long, group long"


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of (key, group, n, tokens)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            data, off = raw(part.column(3))
            m = np.diff(off) // 8
            place = np.arange(off[-1] // 8) - np.repeat(off[:-1] // 8, m)
            key, group, n = (np.repeat(part.column(i).to_numpy(), m) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(n), pa.array(place.astype(np.int32)), pa.array(key), pa.array(group)], ["token", "size", "pos", "key", "group"])


def _open(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of lists in order of size, those with members of two groups, without members whose neighbours in size are too far
    from them; a list that is longer than HELD rows before its second group is taken for such a list."""
    left: pa.Table | None = None  # the last list so far
    sure = False  # whether rows of it have been given out

    def chosen(rows: pa.Table, last_too: bool):
        nonlocal left, sure
        token, size, group = (rows.column(i).to_numpy() for i in (0, 1, 4))
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        mixed = np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)
        mixed[0] |= sure
        end = len(rows) if last_too else int(start[-1])
        if not last_too and len(rows) - end > HELD:
            # one of the list's rows stays, as the neighbour of those to come
            mixed[-1], end = True, len(rows) - 1
        near = (token[1:] == token[:-1]) & (100 * size[:-1].astype(np.int64) >= percent * size[1:].astype(np.int64))
        keep = np.repeat(mixed, np.diff(np.append(start, len(rows))))
        keep &= np.append(sure, near) | np.append(near, False)
        out = rows.slice(0, end).filter(pa.array(keep[:end]))
        sure = not last_too and bool(end > start[-1] or (sure and start[-1] == 0))
        left = rows.slice(end) if end < len(rows) else None
        return out.to_batches()

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch])
            yield from chosen(rows, False)
    if left is not None:
        yield from chosen(left, True)


def reached(group: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row of each member or -1, distances): for each group of several members, those of its first to all members."""
    _, lead, inverse, count = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count > 1)
    row = np.full(len(lead), -1)
    row[several] = np.arange(len(several))
    x = folded(sketches, min(map(len, sketches)))
    return row[inverse], np.array([np.bitwise_count(x ^ x[lead[g]]).sum(1, dtype=np.int64) for g in several]).reshape(-1, len(group))


def compared(size: np.ndarray, pos: np.ndarray, group: np.ndarray | None, sketches: list[bytes], percent: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of one list, which come by size, that may link.

    A block is left out when its least size is beyond what any member of the other could link with, or when even
    the best positions leave too few common elements. With groups, pairs of one group are left out, and so are those
    that the distances of their groups' first members rule out. nearest: each member has the likeliest of those before
    it only.
    """
    n, out = len(size), []
    best = np.full(n, 1e18)
    who = np.full(n, -1)
    row, far = reached(group, sketches) if group is not None and n > 8 else (None, None)
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        for c in range(a, n, BLOCK):
            d = min(c + BLOCK, n)
            if 100 * size[b - 1] < percent * size[c]:
                break  # all that follow are larger still
            need = percent * (int(size[a]) + int(size[c])) / (100 + percent)
            if min(pos[a:b].max(), pos[c:d].max()) + 1 + min((size[a:b] - pos[a:b]).max(), (size[c:d] - pos[c:d]).max()) - 1 < need:
                continue
            s, t, p, q = size[a:b, None], size[None, c:d], pos[a:b, None], pos[None, c:d]
            fits = 100 * s >= percent * t
            common = np.minimum(p, q) + 1 + np.minimum(s - p, t - q) - 1
            fits &= (100 + percent) * common >= percent * (s + t)
            if a == c:
                fits &= np.arange(b - a)[:, None] < np.arange(d - c)[None, :]
            if group is not None:
                fits &= group[a:b, None] != group[None, c:d]
            i, j = np.nonzero(fits)
            i, j = i + a, j + c
            for side in (0, 1) if row is not None and len(far) else ():
                # two members are apart at least by the difference of their distances from a group's first member
                own = row[(i, j)[side]]
                apart = np.where(own >= 0, np.abs(far[own, i] - far[own, j]), 0)
                ok = apart * (100 + percent) <= (100 - percent) * (size[i] + size[j])
                i, j = i[ok], j[ok]
            if not len(i):
                continue
            width = min(map(len, sketches[a:b] + sketches[c:d]))
            x, y = folded(sketches[a:b], width), folded(sketches[c:d], width)
            for at in range(0, len(i), 1 << 16):
                ii, jj = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                apart = np.bitwise_count(x[ii - a] ^ y[jj - c]).sum(1, dtype=np.int64)
                total = size[ii] + size[jj]
                ok = apart * (100 + percent) <= (100 - percent) * total
                ii, jj, ratio = ii[ok], jj[ok], apart[ok] / total[ok]
                if not nearest:
                    out.append(np.stack([ii, jj]))
                    continue
                order = np.lexsort((ii, ratio, jj))
                lead = order[np.append(True, jj[order][1:] != jj[order][:-1])] if len(order) else order
                lead = lead[ratio[lead] < best[jj[lead]]]
                best[jj[lead]], who[jj[lead]] = ratio[lead], ii[lead]
    if nearest:
        j = np.flatnonzero(who >= 0)
        return who[j], j
    return tuple(np.concatenate(out, 1)) if out else (who[:0], who[:0])


def _listed(batches: Iterator[pa.RecordBatch], percent: int, grouped: bool, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Candidate pairs from lists (token, cell, size, pos, key, group, sketch) that come whole, in order of size; a pair
    comes once a batch."""
    left: pa.Table | None = None
    held: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            found = np.unique(np.concatenate(held, 1), axis=1)
            held.clear()
            for at in range(0, found.shape[1], 100_000):
                part = found[:, at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[0].copy()), pa.array(part[1].copy())], ["a", "b"])

    def pairs(rows: pa.Table, last_too: bool):
        nonlocal left
        token, cell, size, pos, key, group = (rows.column(i).to_numpy() for i in range(6))
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        start = np.append(np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1]))), len(rows))
        done = len(start) - 1 if last_too else len(start) - 2
        left = rows.slice(start[done]) if start[done] < len(rows) else None
        sketches = rows.slice(0, start[done]).column(6).to_pylist()
        for a, b in zip(start[:done].tolist(), start[1 : done + 1].tolist()):
            if b - a > 1:
                i, j = compared(size[a:b], pos[a:b], group[a:b] if grouped else None, sketches[a:b], percent, nearest)
                x, y = key[a + i], key[a + j]
                other = x != y
                if other.any():
                    held.append(np.stack([np.minimum(x, y)[other], np.maximum(x, y)[other]]))
                if sum(h.shape[1] for h in held) > 500_000:
                    yield from out()
        yield from out()

    for batch in batches:
        if batch.num_rows:
            yield from pairs(pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch]), False)
    if left is not None:
        yield from pairs(left, True)


def _verified(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    @lru_cache(512)
    def of(body: bytes) -> np.ndarray:
        return next(sets(pa.array([zstandard.decompress(body)], pa.binary()), k))[1][0]

    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            s, t = of(x), of(y)
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(100 * both >= percent * (len(s) + len(t) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _slots(keys: pa.Array) -> np.ndarray:
    return (keys.to_numpy().view(np.uint64) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _maybe(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            at = _slots(batch.column(0))
            yield batch.filter(pa.array(bits.value[at >> 3] >> (at & 7) & 1 == 1))


def _verify(spark: SparkSession, pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of pairs of keys, as ids of representatives; a key stands for all sets that have it.

    A bitmap of fixed size (2 MB) first leaves out most other texts, so that those which nothing asks for aren't
    shuffled; the joins are exact.
    """
    pairs = staged(spark, pairs.distinct())
    slots = pairs.select(F.explode(F.array("a", "b")).alias("key")).select(F.shiftrightunsigned("key", 64 - MARK_BITS).alias("slot"))
    place = F.col("slot").bitwiseAND((1 << MARK_BLOCK_BITS) - 1)
    bits = np.zeros((1 << (MARK_BITS - MARK_BLOCK_BITS), (1 << MARK_BLOCK_BITS) // 8), np.uint8)
    for r in slots.groupBy(F.shiftright("slot", MARK_BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(place).alias("body")).collect():
        bits[r["block"]] = np.frombuffer(r["body"], np.uint8)
    marks = spark.sparkContext.broadcast(bits.reshape(-1))
    texts = staged(spark, reps.select("key", "id", "body").mapInArrow(lambda it: _maybe(it, marks), "key long, id long, body binary"))
    both = pairs.join(shuffled(texts.toDF("a", "i", "x")), "a").join(shuffled(texts.toDF("b", "j", "y")), "b").select("i", "j", "x", "y")
    out = staged(spark, both.mapInArrow(lambda it: _verified(it, k, percent), "a long, b long"))
    dropped(spark, texts, pairs)
    marks.unpersist()
    return out


def groups(spark: SparkSession, df: DataFrame, percent: int = 90, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    first = staged(spark, rows.mapInArrow(lambda it: _first(it, k), FIRST))
    table = spark.sparkContext.broadcast(rarity(first))
    docs = first.filter("block is null").select("id", "n", "key", "more")
    # each distinct set once, with one of its texts: what follows reads them without a shuffle
    kept = [F.min(x).alias(x) for x in ("id", "n", "body", "sketch", "least")]
    reps = staged(spark, first.filter("block is null and n > 0").groupBy("key", "more").agg(*kept).withColumn("n", F.col("n").cast("int")))

    def candidates(lists: DataFrame, grouped: bool, nearest: bool) -> DataFrame:
        """Lists (POSTED) of more than LONG_LIST members are split into cells, of two chunks each."""
        long = lists.groupBy("token").agg(F.count("*").alias("m")).filter(F.col("m") > LONG_LIST)
        chunks = F.ceil(F.col("m") / CHUNK).cast("int")
        own = F.pmod(F.xxhash64("key"), chunks).cast("int")
        others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.least(own, c) * 100_000 + F.greatest(own, c))
        cells = F.when(F.col("m").isNull(), F.array(F.lit(0))).otherwise(F.array_distinct(others))
        spread = lists.join(long, "token", "left").join(shuffled(reps.select("key", "sketch")), "key").select("token", F.explode(cells).alias("cell"), "size", "pos", "key", "group", "sketch")
        dealt = spread.repartition(width(spark), "token", "cell").sortWithinPartitions("token", "cell", "size", "key")
        return dealt.mapInArrow(lambda it: _listed(it, percent, grouped, nearest), "a long, b long")

    least = reps.select(F.posexplode("least").alias("pos", "token"), F.col("n").alias("size"), "key", F.lit(0).cast("long").alias("group"))
    near = _verify(spark, candidates(least.select("token", "size", "pos", "key", "group"), False, True), reps, k, percent)

    def grouped(sets: DataFrame, edges: DataFrame) -> DataFrame:
        return sets.join(shuffled(components(spark, edges)), "id", "left").withColumn("group", F.coalesce("component", "id"))

    def opened(posted: DataFrame) -> DataFrame:
        dealt = posted.select("token", "size", "pos", "key", "group").repartition(width(spark), "token").sortWithinPartitions("token", "size", "key")
        return staged(spark, dealt.mapInArrow(lambda it: _open(it, percent), POSTED))

    prefixes = reps.select("key", "id", "body").mapInArrow(lambda it: _prefixes(it, table, k, percent), "key long, id long, n int, tokens binary")
    posted = grouped(prefixes, near).select("key", "group", "n", "tokens").mapInArrow(_posted, POSTED)
    lists = opened(posted)
    # likeliest partners in other groups first, so that a large group is one before all its pairs are asked for
    more = _verify(spark, candidates(lists, True, True), reps, k, percent)
    fewer = opened(lists.drop("group").join(shuffled(grouped(reps.select("key", "id"), near.union(more)).select("key", "group")), "key"))
    rest = _verify(spark, candidates(fewer, True, False), reps, k, percent)
    same = docs.filter("n > 0").join(shuffled(reps.select("key", "more", F.col("id").alias("rep"))), ["key", "more"]).select("id", "rep").filter("id <> rep")
    found = components(spark, near.union(more).union(rest).union(same.toDF("a", "b")))
    dropped(spark, lists, fewer, near, more, rest, reps)
    table.unpersist()
    return docs.select("id", "n").join(shuffled(found), "id", "left").select(_id("id").alias("doc_id"), F.col("n").alias("n_shingles"), _id(F.coalesce("component", "id")).alias("component_id"))


def _id(column):
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NO_ID, column)


def one_of_each(spark: SparkSession, df: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, of which each group keeps one document: that with the smallest id.

    Of rows with the same id and text one stays; rows with a null id all stay.
    """
    found = groups(spark, df, percent, k, id_col, text_col).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    stay = df.filter(F.col(id_col).isNotNull()).join(shuffled(found), F.col(id_col).cast("long") == F.col("__kept"), "left_semi")
    return stay.dropDuplicates([id_col, text_col]).unionByName(df.filter(F.col(id_col).isNull()))
