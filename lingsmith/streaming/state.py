"""Stateful operators over a user's events in order, in their batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingsmith.streaming import keys


def double_taps(events: DataFrame, within_us: int) -> DataFrame:
    """Events that repeat the one before within a time, where that one did not already end a double tap: of a row of
    quick repeats every second one counts."""
    same = (F.lag("event_type").over(keys.by_user()) == F.col("event_type")) & (keys.gap_us() <= within_us)
    quick = events.withColumn("quick", F.coalesce(same, F.lit(False)))
    run = quick.withColumn("run", F.sum((~F.col("quick")).cast("int")).over(keys.by_user().rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id"))
    return run.withColumn("place", place).filter("quick and place % 2 = 0").drop("quick", "run", "place")


def typed_buffers(events: DataFrame, idle_s: int, newline: str, backspace: str) -> DataFrame:
    """(user_id, line, typed, last_id): a line ends at a newline event or a pause; a backspace takes one key back.

    A line's text is a fold over its keys in order: backspaces on an empty line do nothing.
    """
    cut = (keys.gap_us() >= idle_s * 1_000_000) | (F.lag("event_type").over(keys.by_user()) == newline)
    lines = events.withColumn("cut", F.coalesce(cut.cast("int"), F.lit(0))).withColumn("line", F.sum("cut").over(keys.by_user().rowsBetween(Window.unboundedPreceding, 0)))
    pressed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    grouped = lines.filter(F.col("event_type") != newline).groupBy("user_id", "line").agg(pressed.alias("k"), F.max("event_id").alias("last_id"))
    back = lambda acc: F.substr(acc, F.lit(1), F.greatest(F.length(acc) - 1, F.lit(0)))
    step = lambda acc, k: F.when(k["event_type"] == backspace, back(acc)).otherwise(F.concat(acc, F.substring(k["event_type"], 1, 1)))
    return grouped.select("user_id", "line", F.aggregate("k", F.lit(""), step).alias("typed"), "last_id")


def loud(levels: DataFrame, by: str, order: list[str], level: str, decay: float = 0.993, floor: float = 0.01, share: float = 0.2) -> DataFrame:
    """loud: at least the floor and a share of the recent peak, which decays by a factor each row.

    peak_i is the largest level_j * decay^(i-j), so it is a running maximum of level_j / decay^j times decay^i; it is
    worked out in logarithms so that powers don't overflow.
    """
    w = Window.partitionBy(by).orderBy(*order)
    i = F.row_number().over(w)
    lifted = F.when(F.col(level) > 0, F.ln(F.col(level)) - F.col("_i") * F.ln(F.lit(decay)))
    x = levels.withColumn("_i", i).withColumn("_m", F.max(lifted).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    peak = F.exp(F.col("_m") + F.col("_i") * F.ln(F.lit(decay)))
    return x.withColumn("peak", F.coalesce(peak, F.lit(0.0))).withColumn("loud", F.col(level) >= F.greatest(F.lit(floor), share * F.col("peak"))).drop("_i", "_m")


def watchdog(want: Column, running: Column, granted: Column, gap_ms: Column, period_ms: int) -> Column:
    """What to do with a capture: stop it, restart it after a sleep (a gap over three periods), start it, or nothing."""
    return F.when(running & (~want | ~granted), "stop").when(running & (gap_ms > 3 * period_ms), "restart").when(~running & want & granted, "start").otherwise("none")


def sticky_direction(words: DataFrame, by: list[str]) -> DataFrame:
    """words (…by, pos, crossed, settled) with `direction`, as it stood before each: a crossing sets it, a settled word that
    stayed as typed clears it."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    said = F.last(F.when(F.col("crossed"), "across").when(F.col("settled"), "none"), ignorenulls=True).over(w)
    return words.withColumn("direction", F.when(said == "across", said))


def undone(events: DataFrame, fix: str, undo: str, within_s: int, listed_at: int) -> DataFrame:
    """(user_id, event_id, rejections, listed): undos right after a fix, counted; from `listed_at` on the word is left alone."""
    hit = (F.col("event_type") == undo) & (F.lag("event_type").over(keys.by_user()) == fix) & (keys.gap_us() <= within_s * 1_000_000)
    x = events.withColumn("hit", F.coalesce(hit, F.lit(False))).filter("hit")
    n = F.count("*").over(keys.by_user().rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("rejections", n).select("user_id", "event_id", "rejections", (F.col("rejections") >= listed_at).alias("listed"))


def tails(events: DataFrame, fix: str, backspace: str) -> DataFrame:
    """(user_id, fix_id, tail, cancelled): keys after each fix up to the next, appended to it; a backspace takes one back,
    and on an empty tail it cancels the fix for good."""
    number = F.sum((F.col("event_type") == fix).cast("int")).over(keys.by_user().rowsBetween(Window.unboundedPreceding, 0))
    x = events.withColumn("fix", number).filter("fix > 0")
    pressed = F.array_sort(F.collect_list(F.when(F.col("event_type") != fix, F.struct("ts", "event_id", "event_type"))))
    grouped = x.groupBy("user_id", "fix").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("fix_id"), pressed.alias("k"))
    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("cancelled"))

    def step(acc: Column, k: Column) -> Column:
        back, empty = k["event_type"] == backspace, acc["tail"] == ""
        tail = F.when(acc["cancelled"], acc["tail"]).when(back, F.substr(acc["tail"], F.lit(1), F.greatest(F.length(acc["tail"]) - 1, F.lit(0)))).otherwise(F.concat(acc["tail"], F.substring(k["event_type"], 1, 1)))
        return F.struct(tail.alias("tail"), (acc["cancelled"] | (back & empty)).alias("cancelled"))

    return grouped.select("user_id", "fix_id", F.aggregate("k", start, step).alias("s")).select("user_id", "fix_id", "s.tail", "s.cancelled")


def parts(events: DataFrame, least_s: float, pause_s: float, silence_s: float, most_s: float) -> DataFrame:
    """(user_id, part, first_id, n): speech cut into parts: at a pause once a part has gone on for long enough, at a silence,
    and where a part has gone on for too long. Where a part begins depends on where the one before ended, so it is a fold."""
    said = F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")))
    grouped = events.groupBy("user_id").agg(said.alias("k"))
    none = F.array().cast("array<struct<first: bigint, n: bigint>>")
    start = F.struct(F.lit(None).cast("long").alias("began"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("first"), F.lit(0).cast("long").alias("n"), none.alias("out"))
    us = lambda s: F.lit(int(s * 1_000_000)).cast("long")

    def step(acc: Column, k: Column) -> Column:
        gap, gone = k["at"] - acc["last"], acc["last"] - acc["began"]
        cut = acc["last"].isNull() | (gap >= us(silence_s)) | ((gap >= us(pause_s)) & (gone >= us(least_s))) | (k["at"] - acc["began"] >= us(most_s))
        done = F.when(cut & acc["last"].isNotNull(), F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n"))))).otherwise(acc["out"])
        return F.struct(F.when(cut, k["at"]).otherwise(acc["began"]).alias("began"), k["at"].alias("last"), F.when(cut, k["event_id"]).otherwise(acc["first"]).alias("first"), F.when(cut, F.lit(1).cast("long")).otherwise(acc["n"] + 1).alias("n"), done.alias("out"))

    end = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n"))))
    return grouped.select("user_id", F.posexplode(F.aggregate("k", start, step, end)).alias("part", "p")).select("user_id", F.col("part").cast("long").alias("part"), F.col("p.first").alias("first_id"), "p.n")


def chords(events: DataFrame, press: str, release: str, hold_us: int) -> DataFrame:
    """(event_id, chord): each press as a tap or, held for long enough, a hold; another key before that spoils it."""
    nxt = F.lead("event_type").over(keys.by_user())
    held = F.unix_micros(F.lead("ts").over(keys.by_user()).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.when(held.isNull() | (held >= hold_us), "hold").when(nxt == release, "tap").otherwise("spoiled")
    return events.select("event_id", "event_type", kind.alias("chord")).filter(F.col("event_type") == press).drop("event_type")
