"""Order-dependent operators on keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(df: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Rows whose state differs from the one before, with ``previous``."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("previous", F.lag(state).over(w)).where(F.col("previous") != F.col(state))


def first_of(df: DataFrame, by: list[Column | str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; one row by aggregation, which combines before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def streaks(df: DataFrame, by: list[str], order: str, good: Column) -> DataFrame:
    """Best and current run of good rows of each key."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("_bad", F.sum(F.when(good, 0).otherwise(1)).over(w)).withColumn("_good", good.cast("int"))
    runs = rows.groupBy(*by, "_bad").agg(F.sum("_good").alias("_n"))
    return runs.groupBy(*by).agg(F.max("_n").alias("best"), F.max_by("_n", "_bad").alias("current"))
