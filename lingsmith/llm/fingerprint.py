"""Document fingerprints: a canonical exact digest.

A text is put in NFKC, case-folded, its white space folded to single blanks, and hashed to 128 bits. Rows with the
same hash form a bucket, in which the canonical bytes are compared; should a bucket hold different ones, each gets
a number of its own, so that equal fingerprints mean equal canonical texts.

Defined cases: a null text is an empty one; equal texts have equal fingerprints; in the order of documents, null
ids come first and equal ids follow their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingsmith.llm._spark import buckets, dropped, id_bounds, staged

SEED = 0
#: Of the second hash, which tells apart the members of a bucket that the first does not.
OTHER = 0x5EED


def canonical(text: str) -> bytes:
    """NFKC, case folding, NFKC again as folding may undo it, runs of white space as one blank, none at the ends.

    >>> canonical(" Ｓtraße\\n\\tX ") == canonical("STRASSE x")
    True
    """
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split()).encode()


def digest(data: bytes, bits: int = 128) -> tuple[str, str]:
    """The wide hash in hex, cut to `bits` (for tests of full buckets), and the second one."""
    wide = f"{xxhash.xxh3_128_intdigest(data, SEED) >> (128 - bits):0{-(-bits // 4)}x}"
    return wide, xxhash.xxh3_128_hexdigest(data, OTHER)


def _canonical(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Hash, second hash and packed canonical text, each distinct one once in a run of rows."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        seen: dict[bytes, None] = {}
        size = 0
        for text in batch.column(0):
            data = canonical(text.as_py() or "")
            if data not in seen:
                seen[data] = None
                size += len(data)
            if size > 8_000_000:
                yield _rows(seen, bits, pack)
                seen, size = {}, 0
        if seen:
            yield _rows(seen, bits, pack)


def _rows(seen, bits, pack):
    both = [digest(x, bits) for x in seen]
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in both]), pa.array([b for _, b in both]), pa.array([pack.compress(x) for x in seen], pa.binary())], ["digest", "other", "packed"])


def full_buckets(spark: SparkSession, df: DataFrame, text_col: str = "text", bits: int = 128) -> DataFrame:
    """(digest, other, variant) of the texts in buckets that hold different canonical texts; none, as a rule.

    Tasks send each distinct text once, and the smallest and largest bytes of a bucket are found by partial
    aggregation, so a text that a third of all rows share costs a row per task.
    """
    found = df.select(F.col(text_col).alias("text")).mapInArrow(lambda it: _canonical(it, bits), "digest string, other string, packed binary")
    clash = staged(spark, found.groupBy("digest").agg(F.min("packed").alias("lo"), F.max("packed").alias("hi")).filter("lo <> hi").select("digest"))
    if not clash.limit(1).count():
        return clash.select("digest", F.lit("").alias("other"), F.lit(0).alias("variant"))
    from pyspark.sql import Window

    again = found.join(clash, "digest", "left_semi").groupBy("digest", "other").agg(F.min("packed").alias("packed"))
    return staged(spark, again.select("digest", "other", F.row_number().over(Window.partitionBy("digest").orderBy("packed")).alias("variant")))


def fingerprints(spark: SparkSession, df: DataFrame, text_col: str = "text", bits: int = 128) -> DataFrame:
    """df with a column fingerprint."""
    name = F.pandas_udf(lambda s: s.map(lambda x: "".join(digest(canonical(x or ""), bits))), "string")
    clash = full_buckets(spark, df, text_col, bits)
    cut = -(-bits // 4)
    kept = df.columns
    out = df.withColumn("__d", name(F.col(text_col))).withColumn("__digest", F.substring("__d", 1, cut)).withColumn("__other", F.substring("__d", cut + 1, 32))
    names = clash.select(F.col("digest").alias("__digest"), F.col("other").alias("__other"), F.col("variant").alias("__variant"))
    return out.join(names, ["__digest", "__other"], "left").select(*kept, _named("__digest", "__variant").alias("fingerprint"))


def _named(digest_col: str, variant: str):
    return F.when(F.col(variant).isNull(), F.col(digest_col)).otherwise(F.concat_ws("-", digest_col, F.col(variant).cast("string")))


def _keyed(batches: Iterator[pa.RecordBatch], bounds: np.ndarray, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed texts by id range; the first document of a range also goes to the end of the range before."""
    pack = zstandard.ZstdCompressor(level=1)
    last = len(bounds)
    back = dict(zip(firsts[1:].tolist(), firsts.tolist()))  # first id of a range -> that of the range before
    wrap = int(firsts[0]) if len(firsts) else None
    for batch in batches:
        ids = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        at = buckets(ids, bounds)
        bucket, order, doc, body, extra = [], [], [], [], []
        for b, i, text in zip(at.tolist(), ids.tolist(), batch.column(1)):
            data = pack.compress((text.as_py() or "").encode())
            to = [(b, 0)]
            if i in back:
                to.append((int(buckets(np.array([back[i]]), bounds)[0]), 1))
            if i == wrap:
                to.append((int(buckets(firsts[-1:], bounds)[0]), 2))
            for x, more in to:
                bucket.append(x), order.append(more), doc.append(i), body.append(data)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(order, pa.int32()), pa.array(doc, pa.int64()), pa.array(body, pa.binary())], ["bucket", "extra", "doc_id", "body"])


PROBED = "doc_id long, n_chars long, edited_sha256 string, digest string, other string, edited_digest string, edited_other string, near_edited double, near_next double"


def _probed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in order, with the document that follows the range at its end."""
    unpack = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in PROBED.split(", ")]
    last = None
    done_bucket = None
    rows: list[tuple] = []

    def row(doc: int, text: str, after: str) -> tuple:
        n = len(text)
        cut = n // 2
        edited = text[: n - cut] + after[:cut] if cut else text
        own, changed, following = canonical(text), canonical(edited), canonical(after)
        return (None if doc == -(2**63) else doc, n, hashlib.sha256(edited.encode()).hexdigest(), *digest(own, bits), *digest(changed, bits), float(own == changed), float(own == following))

    def out():
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for bucket, extra, doc, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket == done_bucket:
                continue  # further rows with the id of the document that follows
            text = unpack.decompress(body).decode() if body else ""
            if last is not None:
                rows.append(row(*last, text))
            last = None if extra else (doc, text)
            if extra:
                done_bucket = bucket
            if len(rows) >= 2000:
                yield out()
                rows = []
    if rows:
        yield out()


def probe(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half gives way to the next document's start.

    Packed texts are shuffled once, to ranges of ids; the first document of each range is also sent to the range
    before it. Likeness of exact digests is 1 or 0.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    clash = full_buckets(spark, rows, "text", bits)
    bounds = np.array(id_bounds(rows, "doc_id"), np.int64)
    edges = [*bounds.tolist()]
    ids = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"))
    firsts = np.array(sorted(r["m"] for r in ids.mapInArrow(lambda it: _firsts(it, np.array(edges, np.int64)), "b int, m long").groupBy("b").agg(F.min("m").alias("m")).collect()), np.int64)
    dealt = rows.mapInArrow(lambda it: _keyed(it, bounds, firsts), "bucket int, extra int, doc_id long, body binary").repartitionById(len(edges) + 1, F.col("bucket")).sortWithinPartitions("bucket", "extra", "doc_id", "body")
    found = dealt.mapInArrow(lambda it: _probed(it, bits), PROBED)
    for own in ("", "edited_"):
        names = clash.select(F.col("digest").alias(f"{own}digest"), F.col("other").alias(f"{own}other"), F.col("variant").alias(f"{own}variant"))
        found = found.join(names, [f"{own}digest", f"{own}other"], "left")
    return found.select("doc_id", "n_chars", "edited_sha256", _named("digest", "variant").alias("fingerprint"), _named("edited_digest", "edited_variant").alias("edited_fingerprint"), "near_edited", "near_next")


def _firsts(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Smallest id of each range in a batch."""
    for batch in batches:
        ids = np.sort(batch.column(0).to_numpy())
        at, first = np.unique(buckets(ids, bounds), return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(ids[first])], ["b", "m"])
