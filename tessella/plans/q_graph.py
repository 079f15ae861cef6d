"""Queries of graph and rule operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import graph as G
from tessella.operators.datalog import Atom, Rule, contradictions, fixpoint, normal, verdict
from tessella.plans.registry import query
from tessella.sources.tables import HIERARCHY_SQL, TRADE_SQL, events, hierarchy_edges, table, trade_edges

BOTH = f"WITH RECURSIVE e AS (SELECT source, target FROM ({TRADE_SQL})), b AS (SELECT * FROM e UNION SELECT target, source FROM e)"


@query(f"{BOTH}, r(node, depth) AS (SELECT 'p1', 0 UNION SELECT target, depth + 1 FROM r JOIN b ON node = source WHERE depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def g_bfs(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([("p1",)], "node string")
    return G.reach(G.both_ways(trade_edges(spark, d)), start, 2)


@query(f"{BOTH}, r(node, depth) AS (SELECT 'p1', 0 UNION SELECT target, depth + 1 FROM r JOIN b ON node = source WHERE depth < 2), n AS (SELECT node FROM r WHERE depth < 2) SELECT source, target, weight FROM ({TRADE_SQL}) WHERE source IN (SELECT node FROM n) OR target IN (SELECT node FROM n)")
def g_bfs_links(spark: SparkSession, d: str) -> DataFrame:
    """The links that the search follows: those of all nodes that it expands."""
    edges = trade_edges(spark, d)
    start = spark.createDataFrame([("p1",)], "node string")
    return G.incident(edges, G.reach(G.both_ways(edges), start, 2).where("depth < 2"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()


def _rank_sql(rounds: int) -> str:
    parts = [f"e AS MATERIALIZED (SELECT source, target FROM ({HIERARCHY_SQL})), n AS MATERIALIZED (SELECT source AS node FROM e UNION SELECT target FROM e), o AS MATERIALIZED (SELECT source, count(*) AS c FROM e GROUP BY 1), r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)"]
    for i in range(rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT source FROM o)) / (SELECT count(*) FROM n)) AS rank FROM n LEFT JOIN (SELECT target, sum(rank / c) AS got FROM e JOIN r{i} ON source = node JOIN o USING (source) GROUP BY 1) ON node = target)"
        )
    return "WITH " + ", ".join(parts) + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_sql(5))
def g_pagerank(spark: SparkSession, d: str) -> DataFrame:
    e = hierarchy_edges(spark, d)
    return G.pagerank(e, _nodes(e), rounds=5, tolerance=0).select("node", F.round("rank", 6).alias("rank"))


@query(f"WITH e AS ({HIERARCHY_SQL}) SELECT node, wave::INT AS wave FROM (SELECT DISTINCT source AS node, CASE WHEN source[1] = 'c' THEN 0 ELSE 1 END AS wave FROM e WHERE source[1] = 'c' OR source IN (SELECT target FROM e) UNION SELECT source, 0 FROM e WHERE source NOT IN (SELECT target FROM e) UNION SELECT target, 2 FROM e WHERE target[1] = 'r')")
def g_topo(spark: SparkSession, d: str) -> DataFrame:
    e = hierarchy_edges(spark, d)
    return G.waves(e, _nodes(e))


@query(f"WITH e AS ({HIERARCHY_SQL}), w AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal < 0), a AS (SELECT target AS node, 0.05 * count(*) AS p FROM w JOIN e ON node = source GROUP BY 1), b AS (SELECT target AS node, sum(p) * 0.5 AS p FROM a JOIN e ON node = source GROUP BY 1) SELECT node, round(p, 6) AS gap FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def g_gap_prop(spark: SparkSession, d: str) -> DataFrame:
    wrong = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return G.spread_gaps(hierarchy_edges(spark, d), wrong).select("node", F.round("gap", 6).alias("gap"))


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS gap FROM events ORDER BY gap DESC, event_id LIMIT 10")
def g_top_gaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("gap")).orderBy(F.desc("gap"), "event_id").limit(10)


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC LIMIT 20")
def g_temporal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'click' AND ts >= timestamp_ntz '2024-01-10 00:00:00'").orderBy(F.desc("ts")).limit(20).select("event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1 AS current FROM events WHERE ts <= TIMESTAMP '2024-01-15'")
def g_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where(F.col("us") <= 1705276800000000)
    return e.select("event_id", (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("us"))) == 1).alias("current"))


@query("SELECT DISTINCT lower(trim(c_mktsegment)) AS a, lower(trim(c_nationkey::VARCHAR)) AS b FROM customer")
def dl_facts(spark: SparkSession, d: str) -> DataFrame:
    return normal(table(spark, d, "customer").select(F.col("c_mktsegment").alias("a"), F.col("c_nationkey").cast("string").alias("b")))


#: The default rules.
RULES = [
    Rule(Atom("is_a", ("X", "Z")), (Atom("is_a", ("X", "Y")), Atom("is_a", ("Y", "Z")))),
    Rule(Atom("part_of", ("X", "Z")), (Atom("part_of", ("X", "Y")), Atom("part_of", ("Y", "Z")))),
    Rule(Atom("deprecated", ("X",)), (Atom("is_a", ("X", "Y")), Atom("deprecated", ("Y",)))),
    Rule(Atom("recommended", ("X",)), (Atom("is_a", ("X", "Y")), Atom("recommended", ("Y",)))),
]


def _facts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    e = hierarchy_edges(spark, d)
    return {
        "part_of": e, "is_a": e,
        "deprecated": table(spark, d, "region").where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("a")),
        "recommended": table(spark, d, "nation").where("n_regionkey = 2").select(F.concat(F.lit("n"), "n_nationkey").alias("a")),
    }


CLOSURE = f"e AS ({HIERARCHY_SQL}), c(a, b) AS (SELECT source, target FROM e UNION SELECT a, target FROM c JOIN e ON b = source)"


@query(f"WITH RECURSIVE {CLOSURE} SELECT a, b FROM c")
def dl_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return fixpoint({"part_of": hierarchy_edges(spark, d)}, RULES[1:2])["part_of"].toDF("a", "b")


@query(f"WITH RECURSIVE {CLOSURE}, dep AS (SELECT 'r1' AS x UNION SELECT a FROM c WHERE b = 'r1'), base AS (SELECT 'n' || n_nationkey AS x FROM nation WHERE n_regionkey = 2), rec AS (SELECT x FROM base UNION SELECT a FROM c JOIN base ON b = x) SELECT 'deprecated' AS p, x FROM dep UNION ALL SELECT 'recommended', x FROM rec")
def dl_rules(spark: SparkSession, d: str) -> DataFrame:
    k = fixpoint(_facts(spark, d), RULES)
    return k["deprecated"].toDF("x").select(F.lit("deprecated").alias("p"), "x").unionByName(k["recommended"].toDF("x").select(F.lit("recommended").alias("p"), "x"))


