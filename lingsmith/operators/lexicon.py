"""Word lists: counts, frequencies, models of letters, lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingsmith.functions import phonetic
from lingsmith.functions import text as X


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by shuffle and merge, never by broadcast: for sides that grow with the input. Spark sizes tables by
    their compressed files and an array that is exploded as one element, and would collect too much on the driver."""
    return df.hint("merge")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): words of letters, lower-cased; sums are held at the largest long."""
    found = docs.select("lang", F.explode(X.words(F.col("text"))).alias("w"))
    return found.groupBy("lang", F.lower("w").alias("word")).agg(F.count("*").alias("n"))


def log_frequency(counts: DataFrame) -> DataFrame:
    """freq: ln(1+n) over its maximum in the language, in 0..1."""
    top = counts.groupBy("lang").agg(F.max("n").alias("top"))
    return counts.join(top, "lang").select("lang", "word", "n", F.round(F.least(F.lit(1.0), F.log1p("n") / F.log1p("top")), 6).alias("freq"))


def top_words(counts: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def held_out(counts: DataFrame, every: int, after: int) -> DataFrame:
    """Every n-th word beyond a rank (from 0)."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counts.withColumn("i", F.row_number().over(order) - 1).filter((F.col("i") > after) & (F.col("i") % every == 0))


def grams(words: DataFrame) -> DataFrame:
    """(…, tri, ctx) of each letter of a word, with two marks before it and one after."""
    padded = F.concat(F.lit("^^"), F.col("word"), F.lit("$"))
    at = F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("at")
    return words.withColumn("padded", padded).select("*", at).select(*words.columns, F.expr("substring(padded, at, 3)").alias("tri"), F.expr("substring(padded, at, 2)").alias("ctx"))


def trigrams(counts: DataFrame) -> DataFrame:
    """(lang, tri, weight): sums of ln(1+n)."""
    return grams(counts).groupBy("lang", "tri").agg(F.round(F.sum(F.log1p("n")), 4).alias("weight"))


def naturalness(counts: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """(lang, word, fit): average log10 probability of a word's letters under its language's model."""
    g = grams(counts.withColumn("w", F.log1p("n")))
    tri = g.groupBy("lang", "tri").agg(F.sum("w").alias("t"))
    ctx = g.groupBy("lang", "ctx").agg(F.sum("w").alias("c"))
    letters = counts.select("lang", F.explode(F.split("word", "")).alias("ch")).filter("ch <> ''").groupBy("lang").agg((F.count_distinct("ch") + 1).alias("size"))
    p = F.log10((F.col("t") + smoothing) / (F.col("c") + smoothing * F.col("size")))
    return g.join(tri, ["lang", "tri"]).join(ctx, ["lang", "ctx"]).join(F.broadcast(letters), "lang").groupBy("lang", "word").agg(F.round(F.avg(p), 5).alias("fit"))


def deletes(words: DataFrame, most: int = 2, prefix: int = 7) -> DataFrame:
    """(…, variant): the word's start with up to `most` letters left out: the index of a lookup by as many edits."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    fewer = F.array(F.substring("word", 1, prefix))
    every = fewer
    for _ in range(most):
        fewer = F.array_distinct(F.flatten(F.transform(F.filter(fewer, lambda w: w != ""), cut)))
        every = F.concat(every, fewer)
    return words.withColumn("variant", F.explode(F.array_distinct(every)))


def fuzzy(typed: DataFrame, listed: DataFrame, most: int = 2, by: list[str] | None = None) -> DataFrame:
    """(…by, typed, word, dist) of pairs within `most` edits, a swap of neighbours being one: equal variants give
    candidates, their lengths and then the distance decide. by: columns that both have to share, such as a language."""
    from lingsmith.functions import slips

    by = by or []
    a = deletes(typed.select(*by, "word"), most).withColumnRenamed("word", "typed")
    both = a.join(shuffled(deletes(listed.select(*by, "word"), most)), [*by, "variant"]).filter(F.abs(F.length("typed") - F.length("word")) <= most)
    # a swap is two plain edits, so what is further apart than twice as many is out before Python sees it
    near = both.select(*by, "typed", "word").distinct().filter(F.levenshtein("typed", "word", 2 * most) >= 0)
    return near.withColumn("dist", slips.osa(F.col("typed"), F.col("word"))).filter(F.col("dist") <= most)


def nearest(typed: DataFrame, listed: DataFrame, most: int = 2, by: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(…by, typed, word, dist): the words at the least distance from each typed one, up to `most` edits, itself aside.

    Words with a neighbour one edit away need no lookup by two, whose index is ten times as large. keep: writes the pairs
    of a lookup, which are asked for up to three times, so that each lookup is planned and computed once.
    """
    by = by or []
    found = None
    left = typed.select(*by, "word").distinct()
    for edits in range(1, most + 1):
        hits = keep(fuzzy(left, listed, edits, by).filter("dist > 0"))
        hits = hits if edits == 1 else closest(hits, [*by, "typed"])
        found = hits if found is None else found.union(hits)
        left = left.join(shuffled(hits.select(*by, F.col("typed").alias("word"))), [*by, "word"], "left_anti")
    return found


def closest(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of pairs (…by, word, dist) those at the least distance of each group."""
    least = pairs.groupBy(*by).agg(F.min("dist").alias("_least"))
    return pairs.join(shuffled(least), by).filter(F.col("dist") == F.col("_least")).drop("_least")


def sound_alikes(heard: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """(…by, heard, term, dist): per heard word the nearest term by sound, then the more frequent, then by name."""
    a = heard.withColumn("bones", phonetic.skeleton(F.col("key"))).withColumn("end", F.right("key", F.lit(1))).filter("key <> ''").withColumnRenamed("key", "ka")
    b = terms.withColumn("bones", phonetic.skeleton(F.col("key"))).withColumn("end", F.right("key", F.lit(1))).withColumnRenamed("key", "kb")
    pairs = a.join(b, [*by, "bones", "end"]).filter(phonetic.close(F.col("ka"), F.col("kb"))).withColumn("dist", F.levenshtein("ka", "kb"))
    best = F.min(F.struct("dist", (-F.col("n")).alias("m"), "term")).alias("best")
    return pairs.groupBy(*by, "heard").agg(best).select(*by, "heard", "best.term", "best.dist")


def both_ways(counts: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """(lang, word, n, back, fit): the fit of words and of the same words read backwards."""
    g = grams(counts.withColumn("w", F.log1p("n")))
    tri = g.groupBy("lang", "tri").agg(F.sum("w").alias("t"))
    ctx = g.groupBy("lang", "ctx").agg(F.sum("w").alias("c"))
    letters = counts.select("lang", F.explode(F.split("word", "")).alias("ch")).filter("ch <> ''").groupBy("lang").agg((F.count_distinct("ch") + 1).alias("size"))
    ways = F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("s")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("s"))))
    read = counts.select("lang", F.col("word").alias("listed"), "n", ways.alias("r")).select("lang", "listed", "n", "r.back", F.col("r.s").alias("word"))
    p = F.log10((F.coalesce("t", F.lit(0.0)) + smoothing) / (F.coalesce("c", F.lit(0.0)) + smoothing * F.col("size")))
    scored = grams(read).join(tri, ["lang", "tri"], "left").join(ctx, ["lang", "ctx"], "left").join(F.broadcast(letters), "lang")
    return scored.groupBy("lang", F.col("listed").alias("word"), "back").agg(F.first("n").alias("n"), F.round(F.avg(p), 6).alias("fit"))


def weighted_medians(fits: DataFrame) -> DataFrame:
    """(lang, back, median): the first fit at which half of the weight is reached; weights are merged by fit first."""
    merged = fits.groupBy("lang", "back", "fit").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang", "back").orderBy("fit"))
    total = F.sum("n").over(Window.partitionBy("lang", "back"))
    return merged.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") >= F.col("total") / 2).groupBy("lang", "back").agg(F.min("fit").alias("median"))


def calibration(medians: DataFrame, spread: float = 0.1) -> DataFrame:
    """(lang, hi, lo): medians of words and of reversed words, where they lie far enough apart."""
    both = medians.groupBy("lang").agg(F.max(F.when(~F.col("back"), F.col("median"))).alias("hi"), F.max(F.when(F.col("back"), F.col("median"))).alias("lo"))
    return both.filter(F.col("hi") - F.col("lo") >= spread)


def picked(counts: DataFrame, most: int, step: int = 7919, first: int = 13) -> DataFrame:
    """(i, word): the words in whose stretch of the cumulative counts the places (i * step + first) mod total fall.

    Each word works out for itself which picks are its own, so no pairs of words and picks are formed.
    """
    order = Window.orderBy(F.desc("n"), "word")
    upto = counts.withColumn("lo", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    total = counts.agg(F.sum("n").alias("total"))
    places = F.expr(f"filter(sequence(0L, {most - 1}L), i -> (i * {step} + {first}) % total >= lo and (i * {step} + {first}) % total < lo + n)")
    return upto.join(F.broadcast(total)).select(F.explode(places).alias("i"), "word")


def fits(words: DataFrame, listed: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """(word, fit) of words under the model of letters of another list (word, n)."""
    g = grams(listed.select("word", F.log1p("n").alias("w")))
    tri = g.groupBy("tri").agg(F.sum("w").alias("t"))
    ctx = g.groupBy("ctx").agg(F.sum("w").alias("c"))
    size = listed.select(F.explode(F.split("word", "")).alias("ch")).filter("ch <> ''").agg((F.count_distinct("ch") + 1).alias("size"))
    scored = grams(words.select("word")).join(tri, "tri", "left").join(ctx, "ctx", "left").join(F.broadcast(size))  # one row
    p = F.log10((F.coalesce("t", F.lit(0.0)) + smoothing) / (F.coalesce("c", F.lit(0.0)) + smoothing * F.col("size")))
    return scored.groupBy("word").agg(F.round(F.avg(p), 5).alias("fit"))


def neighbour_words(words: DataFrame, own: DataFrame, near: DataFrame) -> DataFrame:
    """words with `neighbour`: the own list has them neither as they are nor in small letters, the neighbour's has them."""
    flag = lambda df, name, key: df.select(F.col("word").alias(key)).distinct().withColumn(name, F.lit(True))
    x = words.withColumn("_low", F.lower("word"))
    x = x.join(flag(own, "_own", "word"), "word", "left").join(flag(own, "_own_low", "_low"), "_low", "left").join(flag(near, "_near", "_low"), "_low", "left")
    return x.withColumn("neighbour", F.col("_own").isNull() & F.col("_own_low").isNull() & F.col("_near").isNotNull()).drop("_low", "_own", "_own_low", "_near")


def glossary_words(lines: DataFrame) -> DataFrame:
    """(word): the words of terms, lines "term|how it sounds|…" of which only the term counts."""
    term = F.regexp_extract("value", r"^([^|]*)", 1)
    return lines.select(F.explode(F.regexp_extract_all(term, F.lit(r"(\S+)"), 1)).alias("w")).select(X.letters_key(F.col("w")).alias("word")).filter("word <> ''").distinct()
