"""The quantile sketch within its error, merged in any order, and alert rules in batches and streams."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import quantiles as Qu
from tessella.plans.q_sources import samples
from tessella.streaming import alerts as Al
from tessella.streaming.windows import run_to_end

QS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0)


def rows(spark, values, group="g"):
    return spark.createDataFrame([(group, float(v)) for v in values], "g string, v double")


@pytest.mark.parametrize("shape", ["lognormal", "uniform", "both sides", "ties", "one", "huge"])
def test_quantiles_within_their_error(spark, shape):
    rng = np.random.default_rng(5)
    values = {
        "lognormal": rng.lognormal(0, 3, 4000), "uniform": rng.uniform(0, 100, 4000).round(2), "both sides": rng.standard_cauchy(4000), "ties": rng.choice([0.0, 1.0, 1.0, 7.5], 999),
        "one": np.array([3.25]), "huge": np.array([1e-12, 1e-8, 1e11, -1e11, 0.0]),
    }[shape]
    sketch = Qu.merged(Qu.sketched(rows(spark, values).repartition(5), ["g"], "v"), ["g"])
    found = sketch.select(*(Qu.quantile(F.col("sketch"), q).alias(str(i)) for i, q in enumerate(QS))).first()
    ordered = np.sort(values)
    for q, got in zip(QS, found, strict=True):
        want = ordered[math.floor(q * (len(ordered) - 1))]
        assert abs(got - want) <= Qu.ALPHA * abs(want) * (1 + 1e-9) + Qu.LEAST


def test_sketches_of_parts_add_up(spark):
    rng = np.random.default_rng(6)
    a, b = rows(spark, rng.exponential(10, 700)), rows(spark, rng.exponential(1000, 300))
    apart = Qu.sketched(a, ["g"], "v").unionByName(Qu.sketched(b, ["g"], "v"))
    assert Qu.merged(apart, ["g"]).collect() == Qu.merged(Qu.sketched(a.unionByName(b), ["g"], "v"), ["g"]).collect()


def test_sketch_stays_small_and_skips_no_number(spark):
    wide = spark.range(20_000).select(F.lit("g").alias("g"), F.exp(F.col("id") / 400 - 20).alias("v"))
    assert Qu.sketched(wide, ["g"], "v").count() < 6000
    odd = spark.createDataFrame([("g", None), ("g", math.nan), ("g", 2.0)], "g string, v double")
    assert [r.n for r in Qu.sketched(odd, ["g"], "v").collect()] == [1]
    assert Qu.merged(Qu.sketched(odd.limit(0), ["g"], "v"), ["g"]).count() == 0


def test_exact_quantiles_equal_sql(spark):
    """sm_p95 gives the quantiles themselves, not what a bucket stands for."""
    rng = np.random.default_rng(8)
    close = 7.0 + np.arange(3000) * 2.0**-50  # neighbours that fall into one bucket and, for some rounds, into one part
    parts = {"lognormal": rng.lognormal(0, 3, 3001), "close": rng.permutation(close), "ties": rng.choice([-1.0, 0.0, 2.5], 500), "signs": rng.standard_cauchy(2000), "one": [4.25], "far": [-math.inf, -1e300, 1e-300, 5e-324, 1e300, math.inf, 1.0]}
    data = [(g, float(x)) for g, v in parts.items() for x in v] + [(None, 3.0), (None, 4.0), ("empty", None), ("one", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {r.g: r for r in Qu.exact(df, ["g"], "v", {f"q{i}": q for i, q in enumerate(QS)}).collect()}
    con = duckdb.connect()
    con.register("t", pd.DataFrame(data, columns=["g", "v"]).astype({"v": "Float64"}))
    columns = ", ".join(f"quantile_cont(v, {q})" for q in QS)
    want = {r[0]: r[1:] for r in con.execute(f"SELECT g, {columns} FROM t GROUP BY 1").fetchall()}
    assert got.keys() == want.keys()
    for g, r in got.items():
        for a, b in zip(list(r)[1:], want[g], strict=True):
            assert (a is None and b is None) or a == b or math.isclose(a, b, rel_tol=1e-15), (g, list(r), want[g])
    nan = Qu.exact(spark.createDataFrame([("g", 1.0), ("g", math.nan), ("g", 2.0)], "g string, v double"), ["g"], "v", {"half": 0.5, "all": 1.0}).first()
    assert nan.half == 2.0 and math.isnan(nan.all)


def plain_alerts(found):
    """judged() over rows (rule, instance, at minute, value) as a loop."""
    rules, out, since = {r.name: r for r in Al.RULES}, set(), {}
    for rule, instance, at, value in sorted(found):
        r = rules[rule]
        if not (value > r.threshold if r.above else value < r.threshold):
            continue
        begun, last = since.get((rule, instance), (at, at - 1))
        begun = begun if last == at - 1 else at
        since[rule, instance] = begun, at
        out.add((rule, instance, at, "firing" if at - begun >= r.patience else "pending"))
    return out


def test_alerts_equal_a_loop_and_each_rule_fires(spark):
    seen = Al.evaluated(samples(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))).persist()
    found = {(r.rule, r.instance, int(r.at.timestamp()) // 60, r.state) for r in Al.judged(seen).collect()}
    assert found == plain_alerts([(r.rule, r.instance, int(r.at.timestamp()) // 60, r.value) for r in seen.collect()])
    assert {(r, s) for r, _, _, s in found} == {(r.name, s) for r in Al.RULES for s in ("pending", "firing")}


def test_alerts_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows_ = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    batch = Al.evaluated(samples(rows_))
    rows_.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(10**6, k) for k in ("view", "click", "error", "signup", "purchase")], "event_id long, event_type string")
    end.selectExpr("event_id", "timestamp_ntz '2025-01-01 00:00:00' AS ts", "0L AS user_id", "event_type", "1.0D AS value", "'' AS props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows_.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # the latencies, whose sketch is added up before the window closes
    rules = tuple(r for r in Al.RULES if r.kind == "p95") + Al.RULES[:2]
    got = {(r.rule, r.instance, r.at): r.value for r in run_to_end(Al.evaluated(samples(live), rules), "alerts").collect() if r.at.year == 2024}
    want = {(r.rule, r.instance, r.at): r.value for r in Al.evaluated(samples(rows_), rules).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert batch.columns == ["rule", "instance", "at", "value"]
