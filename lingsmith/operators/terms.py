"""Words of texts put right by lists: double capitals, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingsmith.functions import text as X


def double_capitals_undone(texts: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """(by, text): words begun with two capitals as known words; only slipped words are looked up, not whole texts."""
    slips = texts.select(by, F.explode(F.array_distinct(F.filter(X.words(F.col("text")), lambda w: X.caps_slip(w) == "double"))).alias("w")).withColumn("word", F.lower("w"))
    found = slips.join(known, "word", "left_semi").groupBy(by).agg(F.collect_set("w").alias("_known"))

    def right(w: Column) -> Column:
        fixed = F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1)), F.substr(w, F.lit(3)))
        return F.when(F.array_contains("_known", w), fixed).otherwise(w)

    parts = F.regexp_extract_all("text", F.lit(r"(?s)(\p{L}+|[^\p{L}]+)"), 1)
    joined = texts.join(found, by, "left")
    return joined.select(by, F.when(F.col("_known").isNull(), F.col("text")).otherwise(F.array_join(F.transform(parts, right), "")).alias("text"))
