"""Operators whose next step depends on the last one, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import folds as Fo


def plain_accepted(rows, ttl):
    """rows: (group, time, key)."""
    last, out = {}, set()
    for g, t, k in sorted({r for r in rows if r[1] is not None}, key=lambda r: (str(r[0]), r[1], r[2])):
        if g not in last or t - last[g] >= ttl:
            last[g] = t
            out.add((g, t, k))
    return out


def got_accepted(df, ttl):
    return [(r.g, r.t, r.k) for r in Fo.accepted(df, ["g"], "t", "k", ttl).collect()]


@pytest.mark.parametrize("ttl", [1, 7, 100, 10_000])
def test_accepted_equals_a_loop(spark, ttl):
    rng = random.Random(ttl)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randint(-500, 500), k) for k in range(400)]
    rows += [("d", 10 * n, n) for n in range(40)] + [("e", 5, n) for n in range(9)] + [("f", None, 1), ("g", 3, 1), ("g", 3, 1)]
    df = spark.createDataFrame(rows, "g string, t long, k long").withColumn("_e", F.lit(1)).withColumn("id", F.lit(2))
    found = got_accepted(df, ttl)
    assert len(found) == len(set(found)) and set(found) == plain_accepted(rows, ttl)


def test_accepted_of_a_large_group(spark):
    """One group of very many rows and a long chain; no array gathers them and no task gets them all."""
    n, ttl = 100_000, 300
    df = spark.range(n).select(F.lit("hot").alias("g"), (F.col("id") * 7 + F.col("id") % 5).alias("t"), F.col("id").alias("k"))
    rows = [("hot", i * 7 + i % 5, i) for i in range(n)]
    found = Fo.accepted(df, ["g"], "t", "k", ttl)
    assert {(r.g, r.t, r.k) for r in found.collect()} == plain_accepted(rows, ttl)
    source = open(Fo.__file__).read()
    assert "collect_list" not in source and "applyInPandas" not in source


def test_accepted_of_nothing_and_bad_ttl(spark):
    df = spark.createDataFrame([], "g string, t long, k long")
    assert got_accepted(df, 5) == []
    with pytest.raises(ValueError, match="ttl"):
        Fo.accepted(df, ["g"], "t", "k", 0)


def test_fold_carries_state_over_batches(spark):
    """The same results whatever the size of a batch, for groups of one row to very many."""
    rng = random.Random(3)
    rows = [(g, t, rng.random()) for g in range(20) for t in range(rng.choice([1, 3, 50]))] + [(99, t, rng.random()) for t in range(20_000)] + [(None, 1, 0.5), (None, 2, 0.25)]
    rng.shuffle(rows)
    want = {}
    for g, _, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        n, s = want.get(g, (0, 0.5))
        want[g] = (n + 1, 0.85 * s + 0.15 * x)
    df = spark.createDataFrame(rows, "g long, t long, x double").repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("7", "10000"):
            spark.conf.set(name, size)
            found = Fo.fold(df, ["g"], ["t"], ["x"], (0, 0.5), lambda s, x: (s[0] + 1, 0.85 * s[1] + 0.15 * x), tuple, "n long, s double")
            assert {r.g: (r.n, r.s) for r in found.collect()} == want
    finally:
        spark.conf.set(name, before)
    assert Fo.fold(df.limit(0), ["g"], ["t"], ["x"], (0,), lambda s, x: s, tuple, "n long").count() == 0


def test_fold_hands_on_many_groups(spark, monkeypatch):
    monkeypatch.setattr(Fo, "FOLD_ROWS", 10)
    df = spark.range(500).select(F.col("id").alias("g"), F.lit("v").alias("x"))
    found = Fo.fold(df, ["g"], ["g"], ["x"], ("",), lambda s, x: (s[0] + x,), tuple, "x string")
    assert sorted((r.g, r.x) for r in found.collect()) == [(i, "v") for i in range(500)]
