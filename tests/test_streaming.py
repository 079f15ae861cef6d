"""Streams give what batches of the same rows give."""

import pytest
from pyspark.sql import functions as F

from tessella.streaming import windows as W


@pytest.fixture
def stream(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))


def test_metrics(stream):
    batch, live = stream
    want = {(r.start, r.event_type): r.n for r in W.metrics(batch).collect()}
    got = {(r.start, r.event_type): r.n for r in W.run_to_end(W.metrics(live), "metrics", "complete").collect()}
    assert got == want


def test_dedup(stream):
    batch, live = stream
    got = W.run_to_end(W.dedup(live, ["user_id", "event_type"], "60 days"), "dedup").count()
    assert got == batch.select("user_id", "event_type").distinct().count()


def test_rate_limit(stream):
    batch, live = stream
    got = {r.event_id: r.accepted for r in W.run_to_end(W.rate_limit(live, most=2, seconds=86400 * 3), "limit").collect()}
    kept, want = {}, {}
    for r in sorted(batch.collect(), key=lambda r: r.ts):
        recent = [t for t in kept.get(r.user_id, []) if (r.ts - t).total_seconds() < 86400 * 3]
        want[r.event_id] = len(recent) < 2
        kept[r.user_id] = recent + [r.ts] * want[r.event_id]
    assert got == want


def test_sessions(stream):
    batch, live = stream
    closed = {(r.user_id, r.start): r.n for r in W.sessions(batch, "12 hours").collect()}
    got = {(r.user_id, r.start): r.n for r in W.run_to_end(W.sessions(live, "12 hours"), "sessions").collect()}
    assert got and all(closed[k] == n for k, n in got.items())


def test_clicked_or_skipped(spark, tmp_path):
    """Clicks within two days count; a link without one is skipped once the watermark has passed."""
    at = lambda hours: f"timestamp '2024-01-01 00:00:00' + interval {hours} hours"
    sent = [(1, 1, 0), (2, 2, 0), (3, 3, 0), (9, 9, 500)]
    clicks = [(1, 5), (3, 60), (9, 501)]
    s = spark.createDataFrame(sent, "event_id long, user_id long, h int").selectExpr("event_id", "user_id", f"{at(0)} + make_interval(0, 0, 0, 0, h) AS ts")
    c = spark.createDataFrame(clicks, "user_id long, h int").selectExpr("user_id", f"{at(0)} + make_interval(0, 0, 0, 0, h) AS ts")
    want = {1: False, 2: True, 3: True, 9: False}
    assert {r.event_id: r.skipped for r in W.clicked_or_skipped(s, c).collect()} == want
    s.coalesce(1).write.parquet(str(tmp_path / "s"))
    c.coalesce(1).write.parquet(str(tmp_path / "c"))
    live = W.clicked_or_skipped(*(spark.readStream.schema(x.schema).parquet(str(tmp_path / n)) for x, n in ((s, "s"), (c, "c"))))
    got = {r.event_id: r.skipped for r in W.run_to_end(live, "skipped").collect()}
    assert got == want
