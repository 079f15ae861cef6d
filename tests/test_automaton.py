"""Containment of many patterns by one automaton."""

import random

import pytest

from tessella.operators import automaton as A
from tessella.plans import registry


def pairs(texts, patterns):
    return sorted((k, p) for k, t in texts for p in patterns if t is not None and p is not None and p in t)


@pytest.mark.parametrize("block", [200_000, 700])
def test_ten_thousand_patterns_equal_a_search_for_each(spark, monkeypatch, block):
    monkeypatch.setattr(A, "PATTERN_BLOCK", block)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    texts = [(i, word(rng.randint(0, 60))) for i in range(150)] + [(1000, None), (1001, ""), (1002, "a" * 5000)]
    patterns = list({word(rng.randint(1, 7)) for _ in range(11_500)}) + ["aaa", "aaaa", ""] if block > 1000 else list({word(rng.randint(1, 4)) for _ in range(900)})
    df = spark.createDataFrame(texts, "k long, t string")
    found = A.contained(df, "t", spark.createDataFrame([(p, i) for i, p in enumerate(patterns)], "p string, i int"), "p", ["k"])
    got = sorted((r.k, r.p) for r in found.collect())
    assert got == pairs(texts, patterns) and len(got) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hard_patterns(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (2, "")], "k long, t string")
    patterns = spark.createDataFrame([("b", 1), ("b", 2), (None, 3), ("", 4)], "p string, _x int")
    assert sorted((r.k, r.p, r._x) for r in A.contained(df, "t", patterns, "p", ["k"]).collect()) == [(1, "", 4), (1, "b", 1), (1, "b", 2), (2, "", 4)]
    assert A.contained(df, "t", patterns.limit(0), "p", ["k"]).count() == 0
    assert A.contained(df.limit(0), "t", patterns, "p", ["k"]).count() == 0
    assert A.contained(df, "t", patterns.select("p").where("p = 'b'").distinct(), "p", []).columns == ["p"]


@pytest.mark.parametrize("name", ["join_contains", "join_contains_bi", "x_error_pattern"])
def test_registered_queries_have_no_nested_loop(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "MapInArrow" in plan
