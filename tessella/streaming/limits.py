"""Requests that are accepted or rejected, with state in the state store: a sliding log of each client.

``transformWithState`` keeps a list of accepted times of a client.  A timer in event time clears it once the window
behind the last accepted one has passed, so a client that stays away leaves no state.  The store is RocksDB, so that
state need not fit in memory, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "event_id long, user_id long, us long, accepted boolean, remaining int, retry_after_us long"


class SlidingLog(StatefulProcessor):
    """At most ``most`` accepted requests in any ``window_us`` microseconds; rejected ones leave no trace."""

    def __init__(self, most: int, window_us: int) -> None:
        self.most, self.window_us = most, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = sorted(r[0] for r in self.kept.get())
        new = pd.concat(list(rows)).sort_values(["us", "event_id"])  # of one trigger
        out = []
        for event, us in zip(new["event_id"].tolist(), new["us"].tolist(), strict=True):
            kept = [t for t in kept if t > us - self.window_us]
            accepted = len(kept) < self.most
            retry = 0 if accepted else kept[0] + self.window_us - us
            if accepted:
                kept.append(us)
            out.append((event, key[0], us, accepted, self.most - len(kept), retry))
        if kept:
            self.kept.put([(t,) for t in kept])
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer((kept[-1] + self.window_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "us", "accepted", "remaining", "retry_after_us"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def sliding_log(requests: DataFrame, most: int = 30, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """event_id, user_id, us, accepted, remaining, retry_after_us of every request of a stream.

    ``requests`` has event_id, user_id and ``ts`` as a timestamp.  The requests of a trigger are taken in order of
    time, and those of later triggers follow; requests later than the watermark are dropped.
    """
    use_rocksdb(requests.sparkSession)
    own = requests.select("event_id", "user_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    return own.groupBy("user_id").transformWithStateInPandas(SlidingLog(most, seconds * 1_000_000), _OUT, "append", "EventTime")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream makes of all that is there, as a table written under ``folder``; a second call takes what is new."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
