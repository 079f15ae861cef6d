"""Structured Streaming forms of the event operators.

Each takes a stream (or a batch) of events with ``ts`` as a timestamp; state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def metrics(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count, mean and largest value by type and window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's sessions that end after ``gap`` without an event."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def dedup(events: DataFrame, keys: list[str], ttl: str = "24 hours") -> DataFrame:
    """The first event of each key while its watermark lasts."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def rate_limit(events: DataFrame, most: int = 30, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """Accept or reject each request: at most ``most`` accepted ones of a user in ``seconds``.

    Rejected requests leave no trace, so the state holds the accepted times of the window only, and it goes once
    the watermark has passed it.  Requests of one trigger are taken in order of time, and later triggers follow.
    """

    def step(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            now = row.ts.value // 1000
            kept = [t for t in kept if t > now - seconds * 1_000_000]
            out.append((row.event_id, key[0], len(kept) < most))
            if out[-1][2]:
                kept.append(now)
        if kept:
            state.update((kept,))
            state.setTimeoutTimestamp(max(max(kept) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["event_id", "user_id", "accepted"])

    keyed = events.withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(step, "event_id long, user_id long, accepted boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def clicked_or_skipped(sent: DataFrame, clicks: DataFrame, hours: int = 48) -> DataFrame:
    """Sent links with whether a click of the user followed within ``hours``: a stream-stream outer join."""
    s = sent.select(F.col("event_id"), F.col("user_id").alias("u"), F.col("ts").alias("sent_at")).withWatermark("sent_at", "1 hour")
    c = clicks.select(F.col("user_id"), F.col("ts").alias("clicked_at")).withWatermark("clicked_at", "1 hour")
    near = F.expr(f"u = user_id AND clicked_at >= sent_at AND clicked_at <= sent_at + INTERVAL {hours} HOURS")
    return s.join(c, near, "left_outer").select("event_id", "u", "sent_at", F.col("clicked_at").isNull().alias("skipped"))


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its rows; for tests and backfills of bounded results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
