"""An event bus over tables and streams: history, subscribers, lifecycle of stages, states that expire.

Events are rows (event_id, ts, type, project_id, data). A history of the last events is kept in state, by a stream; on a table it is a
top-n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTORY = 1000


def subscribed(events: DataFrame, type_: str | None = None, project_id: str | None = None) -> DataFrame:
    """The events of one type, of one project; on streams and tables alike."""
    d = events if type_ is None else events.filter(F.col("type") == type_)
    return d if project_id is None else d.filter(F.col("project_id") == project_id)


def fan_out(events: DataFrame, subscribers: dict[str, list[Callable[[DataFrame], None]]], checkpoint: str, errors: list | None = None):
    """Start a stream that hands each micro-batch to the subscribers of each type. A subscriber that raises does not keep the others
    from being called; its exception is appended to ``errors``. A batch may come twice after a failure, as with any foreachBatch."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for kind, calls in subscribers.items():
                own = batch.filter(F.col("type") == kind)
                for call in calls:
                    try:
                        call(own)
                    except Exception as e:  # one subscriber's failure is its own
                        if errors is not None:
                            errors.append((number, kind, repr(e)))
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).start()


def history(events: DataFrame, type_: str | None = None, project_id: str | None = None, limit: int = 100, kept: int = HISTORY) -> DataFrame:
    """The newest events, newest first, among the last ``kept`` of all."""
    last = events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(kept)
    return subscribed(last, type_, project_id).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit)


def bounded_history(events: DataFrame, key: str = "project_id", kept: int = HISTORY) -> DataFrame:
    """A stream of each key's last ``kept`` event ids after every batch; the oldest go first. State is bounded by ``kept`` a key."""
    import pandas as pd

    def update(k, batches, state):
        have = list(state.get[0]) if state.exists else []
        for pdf in batches:
            have += [int(x) for x in pdf.sort_values(["ts", "event_id"])["event_id"]]
        have = have[-kept:]
        state.update((have,))
        yield pd.DataFrame({key: [k[0]], "n": [len(have)], "oldest": [have[0] if have else None], "newest": [have[-1] if have else None]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "ts", "event_id").groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n int, oldest long, newest long", "ids array<long>", "update", "NoTimeout")


def alive(rows: DataFrame, now: str, seconds: int = 3600, at: str = "created_at") -> DataFrame:
    """The rows that have not yet expired."""
    return rows.filter(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(at)) <= seconds)


def expiring(events: DataFrame, key: str = "user_id", seconds: int = 3600):
    """A stream of keys whose state is dropped when nothing has come for ``seconds`` of event time: key, events so far, and whether it
    has expired. The watermark bounds the state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(k, batches, state):
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "n": [n], "expired": [True]})
            return
        n, last = (state.get[0] if state.exists else 0), 0
        for pdf in batches:
            n += len(pdf)
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        state.update((n,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + seconds * 1000)
        yield pd.DataFrame({key: [k[0]], "n": [n], "expired": [False]})

    e = events.select(key, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "0 seconds")
    kind = events.schema[key].dataType.simpleString()
    return e.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, expired boolean", "n long", "update", GroupStateTimeout.EventTimeTimeout)


def lifecycle(events: DataFrame, by: tuple[str, ...] = ("audit_id", "stage")) -> DataFrame:
    """started, ended, status and seconds of each stage, from its ``started``, ``completed`` and ``failed`` events."""
    at = lambda *kinds: F.min(F.when(F.col("type").isin(*kinds), F.col("ts")))
    d = events.groupBy(*by).agg(at("started").alias("started"), at("completed", "failed").alias("ended"), F.bool_or(F.col("type") == "failed").alias("_failed"))
    status = F.when(F.col("_failed"), "failed").when(F.col("ended").isNotNull(), "completed").otherwise("running")
    return d.select(*by, "started", "ended", status.alias("status"), (F.unix_timestamp("ended") - F.unix_timestamp("started")).alias("seconds"))


def confirmed(items: DataFrame, sources: int = 2, width: str = "7 days") -> DataFrame:
    """keyword, window, sources and items of keywords that several sources have in a window; on streams within the watermark, by
    exact sets of sources, which are few."""
    e = items.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", "1 day") if e.isStreaming else e
    g = e.groupBy(F.window("ts", width).alias("w"), "keyword").agg(F.collect_set("source").alias("sources"), F.count(F.lit(1)).alias("items"))
    return g.filter(F.size("sources") >= sources).select("keyword", F.col("w.start").alias("start"), F.size("sources").alias("n_sources"), "items")


def schedule(query_of: Callable[[], object], every: str | None):
    """A stream's trigger: a fixed pace, or all that is there and an end, for a scheduler from outside."""
    return {"processingTime": every} if every else {"availableNow": True}


def active(spark) -> list[dict]:
    """The streams that run: name, id, and when the last batch was."""
    return [{"name": q.name, "id": q.id, "last": (q.lastProgress or {}).get("timestamp")} for q in spark.streams.active]
