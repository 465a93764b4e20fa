"""Scores of listed words, votes on targets, majorities of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Scores of words on the language's own list and on others of its script.
OWN, OWN_SPAN = 0.95, 0.05
POOL, POOL_SPAN = 0.92, 0.025


def list_scores(freq: DataFrame, lang: str) -> DataFrame:
    """(word, score, hit) from (lang, word, freq): one aggregation gives a word's own and best other frequency."""
    own = F.max(F.when(F.col("lang") == lang, F.col("freq"))).alias("own")
    other = F.max(F.when(F.col("lang") != lang, F.col("freq"))).alias("other")
    score = F.when(F.col("own").isNotNull(), OWN + OWN_SPAN * F.col("own")).otherwise(POOL + POOL_SPAN * F.col("other"))
    hit = F.when(F.col("own").isNotNull(), "own").otherwise("pool")
    return freq.groupBy("word").agg(own, other).select("word", F.round(score, 6).alias("score"), hit.alias("hit"))


def elected(votes: DataFrame, by: list[str], preferred: str) -> DataFrame:
    """(…by, target, n, electing): most votes win, then electing ones, then the preferred target, then the name."""
    n = votes.groupBy(*by, "target").agg(F.count("*").alias("n"), F.bool_or("electing").alias("electing"))
    order = F.struct((-F.col("n")).alias("m"), (~F.col("electing")).alias("e"), (F.col("target") != preferred).alias("p"), "target")
    return n.groupBy(*by).agg(F.min(F.struct(order.alias("order"), "n", "electing")).alias("b")).select(*by, "b.order.target", "b.n", "b.electing")


def others_majority(rows: DataFrame, by: list[str], flag: str) -> DataFrame:
    """majority: more than half of the other rows of the group have the flag; sums are joined, not windowed, so that a
    long group is spread over tasks."""
    totals = rows.groupBy(*by).agg(F.sum(F.col(flag).cast("long")).alias("_s"), F.count("*").alias("_n"))
    own = F.col(flag).cast("long")
    return rows.join(totals, by).withColumn("majority", 2 * (F.col("_s") - own) > F.col("_n") - 1).drop("_s", "_n")
