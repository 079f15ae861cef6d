"""Sequence operators: transition tables, decay of values, and samples of arms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(df: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """(previous, state, n, probability) over the consecutive rows of each key."""
    previous = F.lag(state).over(Window.partitionBy(*by).orderBy(order))
    n = df.withColumn("previous", previous).where("previous IS NOT NULL").groupBy("previous", state).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("previous")))


def likeliest(table: DataFrame, state: str) -> DataFrame:
    """The most frequent next state of each state; ties go to the smaller name."""
    return table.groupBy("previous").agg(F.min_by(state, F.struct(-F.col("n"), state)).alias("next"))


def _uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1) from keys, one for each number of a draw."""
    with np.errstate(over="ignore"):
        x = key + np.uint64(draw + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def gamma_draws(shape: np.ndarray, key: np.ndarray, first: int = 0, rounds: int = 60) -> np.ndarray:
    """Draws of shapes of 1 or more, by squeezed normals that are accepted or drawn again, all rows at a time."""
    d = shape - 1 / 3
    c, out, left = 1 / np.sqrt(9 * d), d.copy(), np.arange(len(shape))
    for r in range(first, first + 3 * rounds, 3):
        if not len(left):
            break
        u = [_uniform(key[left], r + i) for i in range(3)]
        x = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])
        v = (1 + c[left] * x) ** 3
        good = v > 0
        good[good] = np.log(u[2][good]) < 0.5 * x[good] ** 2 + d[left][good] * (1 - v[good] + np.log(v[good]))
        out[left[good]] = d[left[good]] * v[good]
        left = left[~good]
    return out


def beta_samples(good: Column, bad: Column, key: Column, seed: int = 1) -> Column:
    """A draw from Beta(1 + good, 1 + bad) for each row, the same in every run."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
        keys = k.to_numpy(np.int64).view(np.uint64) ^ np.uint64(seed)
        x, y = (gamma_draws(1 + v.to_numpy(float), keys, first) for v, first in ((a, 0), (b, 1000)))
        return pd.Series(x / (x + y))

    return run(good, bad, F.xxhash64(key))
