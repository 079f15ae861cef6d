"""Graph operators as rounds of joins; every round's table is checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.tables import written as stage


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("source", "target")
    return e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of all nodes within ``depth`` steps along edges, with the least depth.

    Only the frontier is joined in a round, and only against nodes not reached before.
    """
    edges = stage(edges)  # read in every round
    seen = stage(start.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for step in range(1, depth + 1):
        found = edges.join(front.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        front = stage(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that begin or end at one of the nodes, each once, with all their columns."""
    own = nodes.select("node").distinct()
    ends = [edges.join(own.withColumnRenamed("node", c), c, "left_semi") for c in ("source", "target")]
    return ends[0].unionByName(ends[1].join(own.withColumnRenamed("node", "source"), "source", "left_anti"))


def reach_by(edges: DataFrame, start: DataFrame, by: str, depth: int) -> DataFrame:
    """(by, node, depth) as ``reach`` gives it, for every start set (by, node) of its own."""
    edges = stage(edges)
    seen = stage(start.select(by, "node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for step in range(1, depth + 1):
        found = edges.join(front.select(by, F.col("node").alias("source")), "source").select(by, F.col("target").alias("node")).distinct()
        front = stage(found.join(seen, [by, "node"], "left_anti").withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-4, every: int = 5) -> DataFrame:
    """(node, rank); the mass of nodes without edges is spread evenly.  Checkpointed every few rounds."""
    out = edges.groupBy("source").agg(F.count(F.lit(1)).alias("out"))
    links = stage(edges.select("source", "target").join(out, "source"))
    total = nodes.count()
    names = stage(nodes.select("node").join(out.withColumnRenamed("source", "node"), "node", "left").select("node", F.col("out").isNull().alias("dangling")))
    ranks = names.withColumn("rank", F.lit(1.0 / max(total, 1)))
    for step in range(1, rounds + 1):
        given = links.join(ranks.select(F.col("node").alias("source"), "rank"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        rank = (1 - damping) / total + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / total)
        new = ranks.withColumnRenamed("rank", "old").join(given, "node", "left").crossJoin(F.broadcast(lost)).select("node", "dangling", "old", rank.alias("rank"))
        if step % every == 0 or step == rounds:
            new = stage(new)
            if new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
                ranks = new.drop("old")
                break
        ranks = new.drop("old")
    return ranks.select("node", "rank")


def waves(edges: DataFrame, nodes: DataFrame, most: int = 1000) -> DataFrame:
    """(node, wave) in topological order by peeling nodes without open prerequisites; a cycle has no wave.

    ``source`` comes before ``target``.
    """
    left_edges, left = edges.select("source", "target").distinct(), stage(nodes.select("node").distinct())
    done = None
    for wave in range(most):
        blocked = left_edges.select(F.col("target").alias("node")).distinct()
        free = stage(left.join(blocked, "node", "left_anti").withColumn("wave", F.lit(wave)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = stage(left.join(free, "node", "left_anti"))
        left_edges = stage(left_edges.join(free.select(F.col("node").alias("source")), "source", "left_anti"))
    rest = left.withColumn("wave", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def spread_gaps(parents: DataFrame, wrong: DataFrame, penalty: float = 0.1, factor: float = 0.5, least: float = 0.01) -> DataFrame:
    """(node, gap): a penalty of each wrong node passes to ancestors, halved at each level until too small."""
    front, level, parts = wrong.select("node", F.lit(penalty).alias("part")), 0, []
    while penalty * factor ** (level + 1) >= least:
        level += 1
        front = front.join(parents.select(F.col("source").alias("node"), F.col("target").alias("up")), "node").groupBy(F.col("up").alias("node")).agg((F.sum("part") * factor).alias("part"))
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("node").agg(F.sum("part").alias("gap"))
