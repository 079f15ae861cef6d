"""Queries of learning paths, graph context, verified claims and retrieval that draws on a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import graph as G
from tessella.operators import retrieval as R
from tessella.operators.datalog import contradictions, fixpoint, verdict
from tessella.plans import q_retrieval as V
from tessella.plans.q_graph import CLOSURE, RULES, _nodes, _rank_sql
from tessella.plans.q_texts import ALL_ENTITIES, DISTINCT_ENTITIES, entities
from tessella.plans.registry import query
from tessella.sources.tables import HIERARCHY_SQL, hierarchy_edges, table

#: Relations that make their source a prerequisite of their target.
PREREQUISITE = ("prerequisite", "requires", "depends_on")
#: Concepts and how they relate; a source is needed for its target, or holds it as a part.
_RELATIONS_SQL = """SELECT 'n' || a.n_nationkey AS source, 'n' || b.n_nationkey AS target, CASE a.n_nationkey % 5 WHEN 0 THEN 'prerequisite' WHEN 1 THEN 'requires' WHEN 2 THEN 'depends_on' WHEN 3 THEN 'part_of' ELSE 'related' END AS relation
 FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 7) % 25 OR b.n_nationkey = a.n_nationkey * 2 AND a.n_nationkey > 0"""


def relations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    k = F.col("k")
    targets = F.explode(F.array_distinct(F.array((k + 7) % 25, F.when((k > 0) & (k * 2 < 25), k * 2).otherwise((k + 7) % 25))))
    kind = F.when(k % 5 == 0, "prerequisite").when(k % 5 == 1, "requires").when(k % 5 == 2, "depends_on").when(k % 5 == 3, "part_of").otherwise("related")
    return n.select(F.concat(F.lit("n"), k).alias("source"), targets.alias("t"), kind.alias("relation")).select("source", F.concat(F.lit("n"), "t").alias("target"), "relation")


def learning_steps(r: DataFrame) -> DataFrame:
    """(source, target) of the steps from a concept: back to what it needs, and on to its parts."""
    back = r.where(F.col("relation").isin(*PREREQUISITE)).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return back.unionByName(r.where("relation = 'part_of'").select("source", "target")).distinct()


_STEPS = f"rel AS ({_RELATIONS_SQL}), st AS (SELECT DISTINCT target AS s, source AS t FROM rel WHERE relation IN ('prerequisite', 'requires', 'depends_on') UNION SELECT source, target FROM rel WHERE relation = 'part_of')"
_PATH = f"WITH RECURSIVE {_STEPS}, r(node, level) AS (SELECT 'n4', 0 UNION SELECT t, level + 1 FROM r JOIN st ON node = s WHERE level < 6), p AS (SELECT node, min(level) AS level FROM r GROUP BY node ORDER BY 2, 1 LIMIT 20)"


def path_to(spark: SparkSession, d: str, goal: str) -> DataFrame:
    """(node, level) of the 20 nearest concepts within six steps of a goal."""
    found = G.reach(learning_steps(relations(spark, d)), spark.createDataFrame([(goal,)], "node string"), 6)
    return found.withColumnRenamed("depth", "level").orderBy("level", "node").limit(20)


@query(f"{_PATH} SELECT node, level::INT AS level FROM p")
def g_prereq(spark: SparkSession, d: str) -> DataFrame:
    return path_to(spark, d, "n4")


_STATUS = "CASE WHEN coalesce(n, 0) = 0 THEN 'NOT_STARTED' WHEN acc >= 0.8 AND n >= 5 THEN 'MASTERED' WHEN acc >= 0.5 AND n >= 2 THEN 'LEARNING' ELSE 'WEAK' END"


@query(f"""{_PATH}, e AS (SELECT 'n' || user_id AS node, count(*) AS n, avg((value > 20 + user_id * 2)::INT) AS acc FROM events WHERE user_id % 6 <> 5 GROUP BY 1),
 b AS (SELECT target AS node, array_to_string(list(DISTINCT source ORDER BY source), ',') AS blocked_by FROM rel WHERE relation IN ('prerequisite', 'requires', 'depends_on') AND source IN (SELECT node FROM p) AND target IN (SELECT node FROM p) GROUP BY 1),
 s AS (SELECT p.node, p.level, {_STATUS} AS status, coalesce(blocked_by, '') AS blocked_by FROM p LEFT JOIN e USING (node) LEFT JOIN b USING (node))
 SELECT node, level::INT AS level, status, CASE status WHEN 'MASTERED' THEN 0.1::DOUBLE WHEN 'LEARNING' THEN 0.4 WHEN 'WEAK' THEN 0.8 ELSE 0.9 END AS gap, blocked_by,
 node = (SELECT node FROM s WHERE status <> 'MASTERED' AND blocked_by = '' ORDER BY level DESC, node LIMIT 1) AS next_up FROM s""")
def g_mastery(spark: SparkSession, d: str) -> DataFrame:
    """The concepts of a path with their status and gap, the prerequisites on the path that come before them, and the one to take up next.

    The next one is not mastered and waits for none; of several the deepest.
    """
    p = path_to(spark, d, "n4")
    ok = F.col("value") > 20 + F.col("user_id") * 2
    e = table(spark, d, "events").where("user_id % 6 <> 5").groupBy(F.concat(F.lit("n"), "user_id").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("int")).alias("acc"))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "NOT_STARTED").when((F.col("acc") >= 0.8) & (F.col("n") >= 5), "MASTERED").when((F.col("acc") >= 0.5) & (F.col("n") >= 2), "LEARNING").otherwise("WEAK")
    need = relations(spark, d).where(F.col("relation").isin(*PREREQUISITE)).join(p.select(F.col("node").alias("source")), "source", "left_semi")
    blocked = need.groupBy(F.col("target").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("blocked_by"))  # at most the 20 of the path
    s = p.join(e, "node", "left").join(blocked, "node", "left").select("node", "level", status.alias("status"), F.coalesce("blocked_by", F.lit("")).alias("blocked_by"))
    first = s.where("status <> 'MASTERED' AND blocked_by = ''").orderBy(F.desc("level"), "node").limit(1).select(F.col("node").alias("next"))
    gap = F.when(F.col("status") == "MASTERED", 0.1).when(F.col("status") == "LEARNING", 0.4).when(F.col("status") == "WEAK", 0.8).otherwise(0.9)
    return s.join(F.broadcast(first), F.lit(True), "left").select("node", "level", "status", gap.alias("gap"), "blocked_by", (F.col("node") == F.col("next")).alias("next_up"))


_QUESTIONS = ["How do REGION_1 and NATION_7 trade with NATION_12", "tell me about camelCase things", "NATION_3 and snake_case"]


@query(f"""WITH RECURSIVE e AS ({HIERARCHY_SQL}), b AS (SELECT source, target FROM e UNION SELECT target, source FROM e), names AS (SELECT 'n' || n_nationkey AS node, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region),
 t AS (SELECT unnest({_QUESTIONS}) AS t, unnest(range({len(_QUESTIONS)})) AS question), e5 AS (SELECT question, {DISTINCT_ENTITIES} AS e FROM (SELECT question, {ALL_ENTITIES} AS e FROM t)), q AS (SELECT question, unnest(e) AS entity, unnest(range(len(e))) AS pos FROM e5),
 m AS (SELECT question, pos, arg_min(node, (length(name), name)) AS node FROM q JOIN names ON contains(lower(name), lower(entity)) GROUP BY ALL), s AS (SELECT question, node FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY pos) AS r FROM m) WHERE r <= 2),
 w(question, node, depth) AS (SELECT question, node, 0 FROM s UNION SELECT question, target, depth + 1 FROM w JOIN b ON node = source WHERE depth < 2)
 SELECT question, node, min(depth)::INT AS depth, coalesce(any_value(name), node) || ' (' || CASE node[1] WHEN 'n' THEN 'nation' WHEN 'r' THEN 'region' ELSE 'customer' END || ')' AS line FROM w LEFT JOIN names USING (node) GROUP BY question, node""")
def g_context(spark: SparkSession, d: str) -> DataFrame:
    """The entities that questions name, at most two each, and what lies within two steps of them, as lines of text."""
    q = spark.createDataFrame(list(enumerate(_QUESTIONS)), "question long, t string")
    found = q.select("question", F.posexplode(entities(F.col("t"))).alias("pos", "entity"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("name"))
    names = n.unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_name").alias("name")))
    m = names.join(F.broadcast(found), F.contains(F.lower("name"), F.lower("entity"))).groupBy("question", "pos").agg(F.min_by("node", F.struct(F.length("name").alias("n"), "name")).alias("node"))  # the questions' entities are broadcast
    start = m.groupBy("question").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "node"))), 1, 2).alias("s")).select("question", F.explode("s.node").alias("node"))
    reached = G.reach_by(G.both_ways(hierarchy_edges(spark, d)), start, "question", 2)
    kind = F.when(F.col("node").startswith("n"), "nation").when(F.col("node").startswith("r"), "region").otherwise("customer")
    return reached.join(names, "node", "left").select("question", "node", "depth", F.concat(F.coalesce("name", "node"), F.lit(" ("), kind, F.lit(")")).alias("line"))


_CLAIMS = """SELECT 'c' || c_custkey AS x, 'r' || CASE WHEN c_custkey % 40 < 10 THEN (SELECT n_regionkey FROM nation WHERE n_nationkey = c_nationkey) WHEN c_custkey % 40 < 20 THEN c_custkey % 5 ELSE 9 END AS y, c_custkey % 40 // 5 AS doc FROM customer"""
_OUT = "SELECT 'r' || r_regionkey AS x, r_regionkey AS doc FROM region WHERE r_regionkey IN (1, 3)"


@query(f"""WITH RECURSIVE {CLOSURE}, claim AS ({_CLAIMS}), dep AS (SELECT a AS x FROM c WHERE b = 'r1' UNION SELECT 'r1'), rec AS (SELECT 'n' || n_nationkey AS x FROM nation WHERE n_nationkey % 8 = 0 UNION SELECT a FROM c WHERE b IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 8 = 0)),
 bad AS (SELECT DISTINCT doc FROM claim WHERE doc IN (6, 7) AND x IN (SELECT x FROM dep) AND x IN (SELECT x FROM rec)), docs AS (SELECT unnest(range(10)) AS doc),
 n AS (SELECT docs.doc, count(claim.x) AS total, count(c.a) AS verified FROM docs LEFT JOIN claim USING (doc) LEFT JOIN c ON claim.x = a AND claim.y = b GROUP BY docs.doc)
 SELECT doc, total, verified, CASE WHEN doc IN (SELECT doc FROM bad) THEN 'CONTRADICTED' WHEN total = 0 THEN 'UNGROUNDED' WHEN verified = total THEN 'VERIFIED' WHEN verified > 0 THEN 'PARTIAL' ELSE 'UNGROUNDED' END AS status FROM n""")
def dl_verify(spark: SparkSession, d: str) -> DataFrame:
    """Answers with claims: contradicted if their subject is both deprecated and recommended, else by the claims that follow from what is known."""
    regions = table(spark, d, "region").where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("a"))
    good = table(spark, d, "nation").where("n_nationkey % 8 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("a"))
    e = hierarchy_edges(spark, d)
    known = fixpoint({"part_of": e, "is_a": e, "deprecated": regions, "recommended": good}, RULES)
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    k = F.col("c_custkey") % 40
    place = F.when(k < 10, F.col("n_regionkey")).when(k < 20, F.col("c_custkey") % 5).otherwise(9)
    claims = table(spark, d, "customer").join(n, "c_nationkey").select(F.concat(F.lit("c"), "c_custkey").alias("x"), F.concat(F.lit("r"), place.cast("string")).alias("y"), F.floor(k / 5).alias("doc"))
    both = contradictions(known, "deprecated", "recommended").toDF("x")
    bad = claims.where("doc IN (6, 7)").join(both, "x", "left_semi").select("doc").distinct().withColumn("bad", F.lit(1))
    facts = known["part_of"].toDF("x", "y").withColumn("ok", F.lit(1))
    counts = claims.join(facts, ["x", "y"], "left").groupBy("doc").agg(F.count(F.lit(1)).alias("total"), F.count("ok").alias("verified"))
    docs = spark.range(10).toDF("doc").join(counts, "doc", "left").join(bad, "doc", "left").na.fill(0)
    return docs.select("doc", "total", "verified", verdict(F.col("total"), F.col("verified"), F.col("bad")).alias("status"))


HYDE = "(SELECT list_transform(range(1, 65), lambda i: 0.7 * a.embedding[i]::DOUBLE + 0.3 * b.embedding[i]::DOUBLE) FROM embeddings a, embeddings b WHERE a.vec_id = 1 AND b.vec_id = 2)"
_MIXED = f"(SELECT vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {HYDE}), 9) AS score FROM embeddings) ORDER BY rank LIMIT 50)"


@query(f"""{_rank_sql(5).rpartition(" SELECT node")[0]}, {V.BM25_SQL}, l AS (SELECT * FROM {_MIXED} UNION ALL SELECT * FROM {V.KEYWORD}), f AS (SELECT id, sum(1.0 / (60 + rank)) AS s FROM l GROUP BY id),
 p AS (SELECT substr(node, 2)::BIGINT AS id, rank AS pr FROM r5 WHERE node[1] = 'c')
 SELECT id, round(s * (1 + 0.15 * coalesce(pr, 0) / (SELECT max(pr) FROM p)), 6) AS score FROM f LEFT JOIN p USING (id) ORDER BY 2 DESC, 1 LIMIT 20""")
def ret_rag_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """A question mixed with a supposed answer, in vectors and words, fused once a document, lifted by its rank in the graph."""
    e = table(spark, d, "embeddings")
    a, b = (F.broadcast(e.where(f"vec_id = {i}").select(F.col("embedding").alias(n))) for i, n in ((1, "qa"), (2, "qb")))
    mixed = F.zip_with("qa", "qb", lambda x, y: 0.7 * x.cast("double") + 0.3 * y.cast("double"))
    question = a.crossJoin(b).select(mixed.alias("q"))  # one row each
    vectors = e.crossJoin(F.broadcast(question)).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 9).alias("score"))
    lists = [(V._list(vectors, "vec_id", 50), 1.0), (V._lists(spark, d)[1], 1.0)]
    links = hierarchy_edges(spark, d)
    p = G.pagerank(links, _nodes(links), rounds=5, tolerance=0).where("node LIKE 'c%'").select(F.substring("node", 2, 20).cast("long").alias("id"), F.col("rank").alias("pr"))
    most = p.agg(F.max("pr").alias("most"))
    f = R.fuse(lists, [], "id").join(p, "id", "left").crossJoin(F.broadcast(most))  # one row
    return f.select("id", F.round(F.col("score") * (1 + 0.15 * F.coalesce("pr", F.lit(0.0)) / F.col("most")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)
