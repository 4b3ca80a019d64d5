"""Event streams: windows, sessions, rate limits and latest states. Each works on a stream and on a table alike where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = "1 hour") -> DataFrame:
    """ts as a timestamp, and a watermark on streams (event time must not be a timestamp without zone)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if e.isStreaming and late else e


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = timed(events).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    g = timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", within: str = "1 day") -> DataFrame:
    e = timed(events, within)
    return e.dropDuplicatesWithinWatermark([key]) if e.isStreaming else e.dropDuplicates([key])


def rate_all(events: DataFrame, hour: int = 3, day: int = 10) -> DataFrame:
    """Each request with how many its user made in the hour and day up to it, and whether that is within the limits."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(t)
    d = events.select("event_id", "user_id", F.count(F.lit(1)).over(w.rangeBetween(-3600, 0)).alias("in_hour"), F.count(F.lit(1)).over(w.rangeBetween(-86400, 0)).alias("in_day"))
    return d.withColumn("allowed", (F.col("in_hour") <= hour) & (F.col("in_day") <= day))


def rate_accepted(events: DataFrame, hour: int = 3, day: int = 10) -> DataFrame:
    """As the limiter itself decides: only accepted requests count, so state runs along each user's requests in order."""
    def decide(keys, batches):
        import pandas as pd

        kept: list[float] = []
        for pdf in batches:
            out = []
            for t in pdf["t"]:
                kept = [x for x in kept if t - x < 86400]
                ok = sum(t - x < 3600 for x in kept) < hour and len(kept) < day
                if ok:
                    kept.append(t)
                out.append(ok)
            yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "allowed": out})

    t = events.select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))

    def run(batches):
        import itertools

        rows = ((u, g) for b in batches for u, g in b.groupby("user_id", sort=False))
        for user, parts in itertools.groupby(rows, key=lambda x: x[0]):
            yield from decide(user, (g for _, g in parts))

    kind = lambda c: events.schema[c].dataType.simpleString()
    return t.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInPandas(run, f"event_id {kind('event_id')}, user_id {kind('user_id')}, allowed boolean")


def latest_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    return events.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"))
