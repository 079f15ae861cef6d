"""Sinks: rows that replace, state of deliveries, and texts for other systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys: two anti-joined parts, no sort."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def replace_documents(chunks: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All chunks of the documents in ``new`` go, its chunks come."""
    return chunks.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def exposition(name: Column, label: str, value: Column, amount: Column) -> Column:
    """A metric line: name{label="value"} amount."""
    return F.format_string(f'%s{{{label}="%s"}} %s', name, value, amount.cast("string"))


def graph_json(edges: DataFrame) -> DataFrame:
    """part and line: each node with its links in both directions counted, and each link, as JSON."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    nodes = ends.groupBy("id").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))
    links = edges.select(F.lit("link").alias("part"), F.to_json(F.struct("source", "target")).alias("line"))
    return nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("id", "out", "in")).alias("line")).unionByName(links)
