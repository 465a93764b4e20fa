"""The bounded training sample of the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, divisor: int, remainder: int) -> Column:
    """Whether a document is kept from training: its id's crc32, as text, leaves this remainder. A null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, divisor: int, remainder: int, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents that aren't held out, spread by a hash of the id.

    Only that many ids are broadcast, so the bound holds at every size. Of repeated labels the largest counts, of
    several texts of one id the least; labels that are null are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label is not null and doc_id is not null")
    known = known.filter(~held_out(F.col("doc_id"), divisor, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
