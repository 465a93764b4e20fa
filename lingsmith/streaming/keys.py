"""Keystroke-like event streams: batch twins of stateful operators, and a streaming form of the session count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def gap_us() -> F.Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by_user()).cast("timestamp"))


def sessions(events: DataFrame, idle_s: int) -> DataFrame:
    """(user_id, session, n): a session ends when nothing came for idle_s seconds or more."""
    new = F.coalesce((gap_us() >= idle_s * 1_000_000).cast("int"), F.lit(0))
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(by_user().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"))


def session_stream(events: DataFrame, idle: str, late: str) -> DataFrame:
    """The same over a stream, by event time with a watermark (an extension: gaps of exactly idle don't end one)."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy("user_id", F.session_window("at", idle)).agg(F.count("*").alias("n"))
