"""The sliding log as a stream: two triggers and a restart, and state that goes after the window."""

import pytest
from pyspark.sql import functions as F

from tessella.streaming import limits as Li

SECOND, BASE = 1_000_000, 1_700_000_000_000_000


def plain(rows, most, window):
    kept, out = {}, {}
    for event, user, us in rows:
        own = [t for t in kept.get(user, []) if t > us - window]
        out[event] = (len(own) < most, most - len(own) - (len(own) < most), 0 if len(own) < most else own[0] + window - us)
        kept[user] = own + [us] * (len(own) < most)
    return out


@pytest.fixture
def feed(spark, tmp_path):
    folder = str(tmp_path / "in")

    def put(rows):
        spark.createDataFrame(rows, "event_id long, user_id long, us long").coalesce(1).write.mode("append").parquet(folder)

    def run():
        live = spark.readStream.schema("event_id long, user_id long, us long").parquet(folder)
        requests = live.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"))
        return Li.run_to_table(Li.sliding_log(requests, most=3, seconds=10), str(tmp_path / "out"))

    return put, run, str(tmp_path / "out" / "state")


def test_two_triggers_and_a_restart_equal_one_fold(feed):
    put, run, _ = feed
    first = [(n, n % 3, BASE + n * SECOND) for n in range(60)]
    second = [(100 + n, n % 3, BASE + (60 + n) * SECOND // 2 + 30 * SECOND) for n in range(60)]
    put(first)
    run()
    put(second)
    found = {r.event_id: (r.accepted, r.remaining, r.retry_after_us) for r in run().collect()}
    assert found == plain(first + second, 3, 10 * SECOND)
    assert {a for a, _, _ in found.values()} == {True, False}
    assert {r.event_id for r in run().collect()} == found.keys()  # nothing new, nothing twice


def kept(spark, state):
    return {r.key.user_id: r.list_element.us for r in spark.read.format("statestore").option("stateVarName", "kept").load(state).collect()}


def test_state_goes_after_the_window(spark, feed):
    put, run, state = feed
    put([(1, 7, SECOND), (2, 8, 2 * SECOND)])
    run()
    assert set(kept(spark, state)) == {7, 8}
    put([(3, 9, 1000 * SECOND)])  # the watermark passes both windows
    run()
    put([(4, 9, 1001 * SECOND)])
    run()
    assert set(kept(spark, state)) == {9}
    found = {r.event_id: r.accepted for r in run().collect()}
    assert found == {1: True, 2: True, 3: True, 4: True}
