"""Alert rules over sliding windows of samples, the same for batches and streams.

A sample has ``ts``, ``instance``, ``metric`` and ``value``.  Every minute each rule looks back over its window and
compares a latency's 95th percentile (by a mergeable sketch), a count, or a mean with its threshold.  A rule that is
broken is pending until it has been so for its time without a break, and then fires.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import quantiles as Qu


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    kind: str  # p95, count or mean
    minutes: int
    above: bool
    threshold: float
    patience: int  # minutes
    severity: str


#: Names, windows, thresholds, times and severities of the alert rules.
RULES = (
    Rule("PM2ServiceHighRestart", "restart", "count", 60, True, 3, 5, "critical"),
    Rule("HighMemoryUsage", "memory", "mean", 1, True, 0.85, 10, "warning"),
    Rule("HighCPUUsage", "cpu", "mean", 5, True, 90, 10, "warning"),
    Rule("DiskSpaceLow", "disk", "mean", 1, False, 0.1, 5, "critical"),
    Rule("QdrantDown", "up", "mean", 1, False, 1, 1, "critical"),
    Rule("HighResponseLatency", "response", "p95", 5, True, 5, 5, "warning"),
    Rule("VectorSearchSlow", "search", "p95", 5, True, 2, 5, "warning"),
)


def evaluated(samples: DataFrame, rules: tuple[Rule, ...] = RULES, late: str = "1 minute") -> DataFrame:
    """rule, instance, at, value: what each rule sees every minute there are samples in its window."""
    seen = samples.withWatermark("ts", late)

    def one(rule: Rule) -> DataFrame:
        own = seen.where(F.col("metric") == rule.metric)
        window = F.window("ts", f"{rule.minutes} minutes", "1 minute")
        if rule.kind == "p95":
            parts = own.withColumn("bucket", Qu.bucket(F.col("value"))).where("bucket IS NOT NULL").groupBy(window, "instance", "bucket").agg(F.count(F.lit(1)).alias("n"))
            found = parts.groupBy("window", "instance").agg(Qu.quantile(Qu.collected(), 0.95).alias("value"))
        else:
            found = own.groupBy(window, "instance").agg((F.count(F.lit(1)).cast("double") if rule.kind == "count" else F.round(F.avg("value"), 9)).alias("value"))
        return found.select(F.lit(rule.name).alias("rule"), "instance", F.col("window.end").alias("at"), "value")

    return reduce(DataFrame.unionByName, map(one, rules))


def judged(seen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, severity, instance, at, value, state of the broken ones: pending, or firing once a break has lasted long enough.

    A minute without samples ends a break.  A rule's minutes of one instance stand in one window; there are as many as
    minutes, whatever the number of samples.
    """
    listed = seen.sparkSession.createDataFrame([(r.name, r.severity, r.above, float(r.threshold), r.patience) for r in rules], "rule string, severity string, above boolean, threshold double, patience int")
    broken = seen.join(F.broadcast(listed), "rule").where(F.when(F.col("above"), F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold")))  # a row a rule is broadcast
    minute = F.unix_seconds("at") / 60
    in_turn = Window.partitionBy("rule", "instance").orderBy("at")
    runs = broken.withColumn("run", minute - F.row_number().over(in_turn))
    since = F.min("at").over(Window.partitionBy("rule", "instance", "run"))
    lasted = (F.unix_seconds("at") - F.unix_seconds(since)) / 60
    return runs.select("rule", "severity", "instance", "at", "value", F.when(lasted >= F.col("patience"), "firing").otherwise("pending").alias("state"))
