"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._util import discard, staged

#: Edges up to which each node's least neighbour is broadcast (16 bytes a node, two nodes an edge at most).
BROADCAST_EDGES = 500_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(u, root) for every node with an edge; root is the least node of its component.

    ``edges`` has two long columns.  Every round is written to the shared folder; the work of a round is
    in proportion to the edges, whatever their shape, as no node's neighbours are gathered.  The least neighbours
    of few edges are broadcast; those of many are written, so that both sides of the join are plain tables and
    adaptive execution splits the rows of a node that has very many.  The rounds are some logarithm of the nodes;
    more than ``most`` would be a fault and raise an error.
    """

    used: list[DataFrame] = []  # tables of a round

    def near(least: DataFrame) -> DataFrame:
        if mark[0] <= BROADCAST_EDGES:
            return F.broadcast(least)
        used.append(staged(least, "least"))
        return used[-1]

    a, b = edges.columns
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = staged(e, "edges")
    mark = _mark(e)
    for _ in range(most):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(near(least), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = near(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        used.append(e)
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(*used)
        used.clear()
        new = _mark(e)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return e.select("u", F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
