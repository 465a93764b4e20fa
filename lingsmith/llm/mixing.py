"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent; the exponent is narrowed down until the weights meet a
target entropy or a limit on repetition; the weights, normalised, become token budgets that are filled with whole
passes over a source and, for the rest, with blocks of a pseudo-random permutation of its documents.

Defined cases: a null source is a source of its own; null and empty texts hold no tokens and are taken in every
whole pass, a source of only such texts once; rows with the same id are taken together; null ids are one id; an
empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingsmith.llm._spark import dropped, shuffled, staged

#: Documents of a block of a permutation, about; blocks of a source at most.
BLOCK_DOCS, MOST_BLOCKS = 1024, 1 << 20
#: Values of the exponent that one pass over the sources tries, and passes.
SECTIONS, PASSES = 32, 7
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
FEW = 10_000


def _sums(shares: DataFrame, at: list[float]) -> list[dict[str, float]]:
    """For each exponent: the sum of powers, entropy of the weights and the ratios that repetition follows from."""
    p = F.col("share")
    cols = []
    for k, a in enumerate(at):
        w = F.pow(p, F.lit(a))
        cols += [F.sum(w).alias(f"z{k}"), F.sum(w * F.log(w)).alias(f"l{k}"), F.max(w / p).alias(f"hi{k}"), F.min(w / p).alias(f"lo{k}")]
    row = shares.agg(*cols).first()
    out = []
    for k in range(len(at)):
        z = row[f"z{k}"] or 1.0
        out.append({"z": z, "entropy": math.log(z) - (row[f"l{k}"] or 0.0) / z, "hi": row[f"hi{k}"] or 1.0, "lo": row[f"lo{k}"] or 1.0})
    return out


def exponent(shares: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: float | None = None) -> float:
    """The least exponent in 0..1 whose weights meet the target.

    entropy: in nats, at most this much (the flattest weights that don't exceed it); repetition: no source is passed
    over more often, where budget is the token budget as a share of all tokens, or None for the least budget that
    takes every document once. Entropy and repetition fall as the exponent grows, so a pass tries SECTIONS values at
    once and keeps the section in which the target is first met. The sources are never collected.
    """

    def met(s: dict[str, float]) -> bool:
        if entropy is not None:
            return s["entropy"] <= entropy
        return (s["hi"] / s["lo"] if budget is None else s["hi"] / s["z"] * budget) <= (repetition or 1.0)

    lo, hi = 0.0, 1.0
    for k in range(PASSES):
        at = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
        first = next((i for i, s in enumerate(_sums(shares, at)) if met(s)), SECTIONS)
        if first == 0:
            return at[0]
        lo, hi = at[first - 1], at[first]
    return hi


def _source(column: str) -> Column:
    return F.struct(F.col(column).isNull().alias("none"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("name")).alias("__source")


def plan(spark: SparkSession, docs: DataFrame, entropy: float | None = None, repetition: float | None = 2.0, budget: float | None = None, source_col: str = "source", id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """A row a source: tokens, weight, passes, and how far the permutation of the rest goes (block, hash and id)."""
    sized = staged(spark, docs.select(_source(source_col), F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("n")))
    totals = sized.groupBy("__source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    whole = totals.agg(F.sum("tokens")).first()[0] or 1
    totals = staged(spark, totals.withColumn("share", F.col("tokens") / F.lit(float(whole))))
    shares = totals.filter("tokens > 0")
    a = exponent(shares, entropy, repetition, budget)
    s = _sums(shares, [a])[0]
    size = float(whole) * (s["z"] / s["lo"] if budget is None else budget)
    quota = F.when(F.col("tokens") > 0, F.col("weight") * size).otherwise(0.0)
    blocks = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS))).cast("int")
    passes = F.when(F.col("tokens") == 0, 1).otherwise(F.floor(quota / F.col("tokens") + 1e-9)).cast("int")
    sources = staged(spark, totals.withColumn("weight", F.when(F.col("tokens") > 0, F.pow("share", F.lit(a)) / s["z"]).otherwise(0.0)).withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), quota - F.col("passes") * F.col("tokens"))).withColumn("blocks", blocks))
    placed = _joined(sized, sources.select("__source", "rest", "blocks")).withColumn("block", _block("h", "blocks"))
    by_block = placed.groupBy("__source", "block", "rest").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("__source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    edge = by_block.withColumn("upto", F.sum("n").over(order)).filter("upto > rest").groupBy("__source").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("upto") + F.col("n")).alias("room")), "block").alias("edge")).select("__source", "edge.*")
    inside = _joined(placed.select("__source", "block", "h", "id", "n"), edge.withColumnRenamed("block", "cut")).filter("block = cut").groupBy("__source", "block", "room", "h", "id").agg(F.sum("n").alias("n"))
    run = F.sum("n").over(Window.partitionBy("__source").orderBy("h", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    # one document more than fits is never taken; the first that doesn't fit ends the block
    last = inside.withColumn("upto", run).filter("upto > room").groupBy("__source").agg(F.min(F.struct("h", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))).alias("id"))).alias("stop"))
    return staged(spark, sources.join(edge.withColumnRenamed("block", "cut"), "__source", "left").join(last, "__source", "left").select("__source", "tokens", "share", "weight", "passes", "rest", "blocks", "cut", "stop"))


def _block(h: str, blocks: str) -> Column:
    return F.pmod(F.shiftrightunsigned(F.col(h), 20), F.col(blocks)).cast("int")


def _joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(sources) if sources.limit(FEW + 1).count() <= FEW else shuffled(sources), "__source")


def mix(spark: SparkSession, docs: DataFrame, entropy: float | None = None, repetition: float | None = 2.0, budget: float | None = None, source_col: str = "source", id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """docs, each row once for every time it is taken, with epoch (from 0) and place (a hash to order an epoch by).

    Texts are neither shuffled nor sorted: a row's fate follows from its source's row in the plan and a hash of its
    id. With budget None every document is taken at least once.
    """
    chosen = plan(spark, docs, entropy, repetition, budget, source_col, id_col, seed).drop("tokens", "share", "weight", "rest")
    kept = [c for c in docs.columns if c not in ("epoch", "place")]
    rows = _joined(docs.select(*kept, _source(source_col), F.xxhash64(F.lit(seed), F.col(id_col)).alias("__h")), chosen)
    here = F.struct(F.col("__h").alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"))
    block = _block("__h", "blocks")
    more = F.when(F.col("cut").isNull(), F.lit(0)).when(block < F.col("cut"), 1).when(block > F.col("cut"), 0).otherwise(F.when(here < F.col("stop"), 1).otherwise(0))
    times = F.col("passes") + more
    return rows.withColumn("__times", times).filter("__times > 0").select(*kept, F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("epoch"), "__h").select(*kept, "epoch", F.xxhash64("__h", "epoch").alias("place"))
