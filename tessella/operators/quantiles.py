"""Quantiles by a mergeable sketch: counts of values in buckets whose bounds grow by a constant factor.

Sketches of any parts of the data add up, in batches, windows and streams, and give the same answer in any order.
The value reported for a quantile is within ``ALPHA`` of the value of that rank, relative to it, whatever the
distribution; its rank is off by no more than the rows of its bucket.  Values from 1e-9 to 1e12 on either side of
zero have fewer than 10,000 buckets.

``exact`` gives the quantiles themselves: the buckets tell where a rank lies, and what lies there is counted again in ever
smaller parts, until a part is one value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.tables import forget, written

ALPHA = 0.005
#: Values nearer to zero count as zero.
LEAST = 1e-9
_FAR = 100_000
#: Equal parts into which ``exact`` cuts the range that holds a rank.
PARTS = 4096


def factor(alpha: float = ALPHA) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """The bucket's number, rising with the value; null for null and what is no number."""
    v = value.cast("double")
    size = F.ceil(F.log(F.abs(v)) / math.log(factor(alpha))) + _FAR
    return F.when(F.isnan(v) | v.isNull(), None).when(v > LEAST, size).when(v < -LEAST, -size).otherwise(F.lit(0).cast("long"))


def middle(number: Column, alpha: float = ALPHA) -> Column:
    """The value that stands for a bucket."""
    g = factor(alpha)
    size = F.pow(F.lit(g), F.abs(number) - _FAR) * (2 / (1 + g))
    return F.when(number == 0, F.lit(0.0)).when(number > 0, size).otherwise(-size)


def sketched(df: DataFrame, by: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """by, bucket, n: the sketch of each group, by a sum that combines before its shuffle."""
    counted = df.withColumn("bucket", bucket(F.col(value), alpha)).where("bucket IS NOT NULL")
    return counted.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by and ``sketch``, the (bucket, n) of a group in one array, whose length the range of values bounds."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n")).groupBy(*by).agg(collected().alias("sketch"))


def collected() -> Column:
    return F.array_sort(F.collect_list(F.struct("bucket", "n")))


def quantile(sketch: Column, q: float, alpha: float = ALPHA) -> Column:
    """The value of rank floor(q * (rows - 1)), within ``alpha`` of it; ``sketch`` is a sorted array of (bucket, n)."""
    total = F.aggregate(sketch, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rank = F.floor(F.lit(q) * (total - 1))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
    step = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["at"].isNull() & (s["seen"] + x["n"] > rank), x["bucket"]).otherwise(s["at"]).alias("at"))
    return middle(F.aggregate(sketch, start, step, lambda s: s["at"]), alpha)


def _level(v: Column) -> Column:
    """``bucket``, for infinite values and NaN too, which is above all others as in ORDER BY."""
    return F.when(F.isnan(v), F.lit(4 * _FAR)).when(F.abs(v) == math.inf, F.signum(v).cast("long") * 3 * _FAR).otherwise(bucket(v))


def exact(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """by and a column for each quantile, between the values of two ranks as SQL's percentile_cont; null without values.

    Every round reads ``df`` and counts what lies in the open ranges in ``PARTS`` parts, with sums that combine before
    their shuffle; a window sees at most the parts of one range.  A round takes the range of a rank down by that factor,
    so the rounds are few: one more than the first for values of a few digits, five at most for any others.
    """
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("v"))
    here = (F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))

    def with_keys(a: DataFrame, b: DataFrame, also: str = "true") -> DataFrame:
        """Rows of ``a`` with those of ``b`` of the same group, null being one."""
        b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
        return a.join(b, F.expr(" AND ".join([*(f"{k} <=> _{k}" for k in keys), also])), "left" if also == "true" else "inner").drop(*(f"_{k}" for k in keys))

    def chosen(parts: DataFrame) -> DataFrame:
        """Of the parts of a rank's range the one that holds it, and the values before that."""
        parts = parts.withColumn("upto", F.col("before") + upto).withColumn("before", F.col("upto") - F.col("n"))
        return parts.where("before <= rank AND rank < upto").select(*keys, "rank", "before", "low", "high")

    first = written(rows.groupBy(*keys, _level(F.col("v")).alias("part")).agg(*here))
    total = first.groupBy(*keys).agg(F.sum("n").alias("total"))
    ends = F.array_distinct(F.array(*(f(F.lit(q) * (F.col("total") - 1)).cast("long") for q in quantiles.values() for f in (F.floor, F.ceil))))
    ranks = total.where("total > 0").select(*keys, F.explode(ends).alias("rank"))
    found = written(chosen(with_keys(first.where("n > 0"), ranks).withColumn("before", F.lit(0).cast("long"))))
    while found.where("low < high").limit(1).count():
        inside = with_keys(rows, found.where("low < high"), "v BETWEEN low AND high")
        part = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * PARTS), F.lit(PARTS - 1))
        now = inside.groupBy(*keys, "rank", "before", part.alias("part")).agg(*here)
        then = written(found.where("NOT low < high").unionByName(chosen(now)))
        forget(found)
        found = then
    named = with_keys(total, found.withColumnRenamed("low", "v"))
    place = {n: F.lit(q) * (F.col("total") - 1) for n, q in quantiles.items()}
    at = [F.max(F.when(F.col("rank") == f(p), F.col("v"))).alias(f"{n}_{i}") for n, p in place.items() for i, f in enumerate((F.floor, F.ceil))]
    out = named.groupBy(*keys, "total").agg(*at)
    share = {n: p - F.floor(p) for n, p in place.items()}
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *(F.when(share[n] == 0, F.col(f"{n}_0")).otherwise(F.col(f"{n}_0") * (1 - share[n]) + F.col(f"{n}_1") * share[n]).alias(n) for n in quantiles))
