"""Lookups in word lists: by key, by affix, by edit distance with ranking, by rows that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingsmith.operators import lexicon as L


def known(words: DataFrame, listed: DataFrame) -> DataFrame:
    """n of each word on the list, 0 if it isn't there."""
    return words.join(listed.select("word", "n"), "word", "left").fillna(0, ["n"])


def stems(words: DataFrame, listed: DataFrame, prefixes: list[str], suffixes: list[str], least: int) -> DataFrame:
    """(word, stem): the first listed rest of at least `least` letters, by order of the affixes, prefixes first."""
    rows = [F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(s).alias("s")) for i, (p, s) in enumerate([(p, "") for p in prefixes] + [("", s) for s in suffixes])]
    cut = words.select("word", F.explode(F.array(*rows)).alias("a")).select("word", "a.*").filter(F.col("word").startswith(F.col("p")) & F.col("word").endswith(F.col("s")))
    rest = F.expr("substring(word, length(p) + 1, length(word) - length(p) - length(s))")
    cut = cut.withColumn("stem", rest).filter(F.length("stem") >= least)
    found = cut.join(listed.select(F.col("word").alias("stem")), "stem", "left_semi")
    return found.groupBy("word").agg(F.min_by("stem", "i").alias("stem"))


def corrections(typed: DataFrame, lists: DataFrame, layout: str | None = None, weight: float = 0.35) -> DataFrame:
    """(lang, typed, word, dist) of typed (lang, word): of each list the best word, the own language's before others.

    lists: (lang, word, freq). The nearest words of a list count, of those the most frequent; with a layout a word's
    frequency is lowered by `weight` times what the slip costs on it. Across lists the distance decides, then the
    frequency, then the own list.
    """
    from lingsmith.functions import slips

    asked = typed.select("word").distinct()
    own = lists.groupBy("word").agg(F.collect_list(F.struct("lang", "freq")).alias("on"))
    # the distance decides across lists, so no list is asked for what lies beyond the nearest word of any
    near = L.nearest(asked, own.select("word"))
    hits = near.join(own, "word").select("typed", "word", "dist", F.explode("on").alias("on")).select("typed", "word", "dist", F.col("on.lang").alias("list"), "on.freq")
    hits = L.closest(hits, ["typed", "list"])
    rank = F.col("freq") - weight * slips.typo_cost(F.col("typed"), F.col("word"), layout) if layout else F.col("freq")
    best = hits.withColumn("rank", rank).groupBy("typed", "list").agg(F.min(F.struct((-F.col("rank")).alias("r"), "word", "dist")).alias("b"))
    pairs = typed.select("lang", F.col("word").alias("typed")).join(best, "typed")
    order = F.min(F.struct("b.dist", "b.r", (F.col("list") != F.col("lang")).alias("other"), "list", "b.word")).alias("b")
    return pairs.groupBy("lang", "typed").agg(order).select("lang", "typed", "b.word", "b.dist")


def suggestions(typed: DataFrame, listed: DataFrame, most: int) -> DataFrame:
    """(lang, typed, suggested): words at the least distance above 0, most frequent first, at most `most` of them."""
    pairs = L.nearest(typed, listed, by=["lang"]).join(listed, ["lang", "word"])
    ordered = Window.partitionBy("lang", "typed").orderBy(F.desc("n"), "word")
    top = pairs.withColumn("_i", F.row_number().over(ordered)).filter(F.col("_i") <= most)
    words = F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"])
    return top.groupBy("lang", "typed").agg(F.array_join(words, " ").alias("suggested"))


def moved(before: DataFrame, now: DataFrame, key: list[str], value: str, tolerance: float, least: float) -> DataFrame:
    """(…key, state): new, gone, better or worse beyond the tolerance, moved beyond `least`, same."""
    b, n = before.withColumnRenamed(value, "_b"), now.withColumnRenamed(value, "_n")
    change = F.col("_n") - F.col("_b")
    state = F.when(F.col("_b").isNull(), "new").when(F.col("_n").isNull(), "gone").when(change > tolerance, "better").when(change < -tolerance, "worse").when(F.abs(change) > least, "moved").otherwise("same")
    return b.join(n, key, "full_outer").select(*key, state.alias("state"))


def neighbours(keys: DataFrame) -> DataFrame:
    """(a, b) of keys (ch, row, x) at most one row and one key's width apart: an equi-join of cells of the keyboard."""
    near = keys.select("ch", "row", "x", F.explode(F.array(F.col("row") - 1, F.col("row"), F.col("row") + 1)).alias("r"))
    other = keys.select(F.col("ch").alias("b"), F.col("row").alias("r"), F.col("x").alias("xb"))
    return near.join(other, "r").filter((F.abs(F.col("x") - F.col("xb")) <= 1.0) & (F.col("ch") != F.col("b"))).select(F.col("ch").alias("a"), "b")


def saturating_sum(n: str):
    """A sum that stays at the largest long."""
    return F.coalesce(F.try_sum(n), F.lit(2**63 - 1))
