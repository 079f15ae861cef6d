"""Key-value views of an append-only log of (key, op, value, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, seq: str, *values: str) -> DataFrame:
    """The last row of each key, by an aggregate that combines before the shuffle."""
    return log.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("_v")).select(key, *(F.col(f"_v.{v}") for v in values))


def live(log: DataFrame, key: str, seq: str, op: str, value: str) -> DataFrame:
    """Keys whose last operation is not a delete, with their values."""
    return latest(log, key, seq, op, value).where(F.col(op) != "DELETE").drop(op)


def compact(log: DataFrame, key: str, seq: str, op: str, value: str, drop_deletes: bool) -> DataFrame:
    """One row a key; deletes stay while older tables may hold the key."""
    rows = log.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(F.struct(op, value), seq).alias("_v")).select(key, seq, F.col(f"_v.{op}").alias(op), F.col(f"_v.{value}").alias(value))
    return rows.where(F.col(op) != "DELETE") if drop_deletes else rows
