"""The idempotent sink: replays, broken batches, states and deliveries."""

import pytest
from pyspark.sql import functions as F

from tessella.sources import ledger as Le

SCHEMA = "message long, ok boolean"


@pytest.fixture
def store(spark, tmp_path):
    return Le.Ledger(spark, f"file://{tmp_path}/sink")


def attempts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(store):
    return {r.message: (r.tries, r.state) for r in Le.states(store.rows(SCHEMA), "message", "ok").collect()}


def test_states_change_from_batch_to_batch_and_a_replay_changes_nothing(spark, store):
    assert found(store) == {}
    first = attempts(spark, [(1, False), (2, True), (3, False)])
    assert store.write(first, 0)
    assert found(store) == {1: (1, "pending"), 2: (1, "sent"), 3: (1, "pending")}
    assert store.write(attempts(spark, [(1, False)] * 4 + [(3, True)]), 1)
    after = {1: (5, "failed"), 2: (1, "sent"), 3: (2, "sent")}
    assert found(store) == after
    assert not store.write(first, 0) and not store.write(attempts(spark, [(9, True)]), 1)
    assert found(store) == after and store.committed() == [0, 1]


def test_a_broken_batch_leaves_no_rows(spark, store):
    store.write(attempts(spark, [(1, True)]), 0)
    bad = attempts(spark, [(n, False) for n in range(40)]).repartition(4).withColumn("ok", F.when(F.col("message") == 17, F.raise_error(F.lit("broken")).cast("boolean")).otherwise(F.col("ok")))
    with pytest.raises(Exception, match="broken"):
        store.write(bad, 1)
    assert found(store) == {1: (1, "sent")}
    # written but not committed, as if the driver had died before the ledger's file
    attempts(spark, [(5, True)]).write.mode("overwrite").parquet(f"{store.folder}/rows/batch=1")
    assert found(store) == {1: (1, "sent")}
    assert store.write(attempts(spark, [(6, True)]), 1)
    assert found(store) == {1: (1, "sent"), 6: (1, "sent")}


def test_a_stream_and_its_restart(spark, store, tmp_path):
    source = f"{tmp_path}/in"
    put = lambda rows: attempts(spark, rows).coalesce(1).write.mode("append").parquet(source)
    live = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    put([(1, False), (2, False)])
    put([(1, True)])
    assert Le.run(live(), store, SCHEMA).count() == 3
    put([(2, False)] * 4)
    Le.run(live(), store, SCHEMA)
    assert found(store) == {1: (2, "sent"), 2: (5, "failed")} and len(store.committed()) == 3


def test_latest_rows(spark, store):
    write = lambda rows, n: store.write(spark.createDataFrame(rows, "k int, v string, w int"), n)
    write([(1, "a", 1), (2, "b", 2)], 0)
    write([(2, "c", None), (3, None, 3)], 1)
    assert {tuple(r) for r in Le.latest(store.rows("k int, v string, w int"), ["k"]).collect()} == {(1, "a", 1), (2, "c", None), (3, None, 3)}


def test_deliveries_are_tried_again(spark):
    requests = spark.createDataFrame([("at once", 1), ("later", 2), ("never", 3), ("raises", 4)], "body string, n int")

    def send(body, attempt):
        if body == "raises" and attempt == 1:
            raise OSError("no route")
        return body == "at once" or body in ("later", "raises") and attempt == 2

    got = {r.body: (r.n, r.tries, r.state) for r in Le.delivered(requests, "body", send).collect()}
    assert got == {"at once": (1, 1, "sent"), "later": (2, 2, "sent"), "never": (3, 3, "failed"), "raises": (4, 2, "sent")}


def test_bodies_hold_a_bounded_number_of_points(spark):
    points = spark.range(1005).select(F.col("id"), F.array(F.col("id").cast("float")).alias("v")).repartition(3)
    got = Le.bodies(points, "id", "v", 50).collect()
    assert sum(r.n for r in got) == 1005 and max(r.n for r in got) == 50 and len(got) <= 24
