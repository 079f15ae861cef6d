"""Queries of filters, projections, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions import words as W
from tessella.operators import folds as Fo
from tessella.operators import windows as O
from tessella.operators.automaton import contained
from tessella.plans import _sql as Q
from tessella.plans.registry import query
from tessella.sources.tables import HIERARCHY_SQL, TRADE_SQL, events, hierarchy_edges, table, trade_edges

ASOF = "TIMESTAMP '2024-02-01'"
NOW_US = 1706745600000000
DAY = 86400000000


# Filters and projections


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal the values given; a value of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src0'")
def filt_eq_dyn(spark: SparkSession, d: str) -> DataFrame:
    return filtered(table(spark, d, "documents"), lang="en", source="src0", n_chars=None).select("doc_id", "lang", "source")


@query("SELECT p_partkey, p_name FROM part WHERE (p_name ILIKE '%a1%' OR p_brand ILIKE '%brand#1%') AND p_size > 10")
def filt_like_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where((F.col("p_name").ilike("%a1%") | F.col("p_brand").ilike("%brand#1%")) & (F.col("p_size") > 10)).select("p_partkey", "p_name")


def or_terms(text: F.Column, question: str) -> F.Column:
    """Does the text hold one of the question's terms of more than two letters?"""
    return S.any_of(F.lower(text), [t for t in question.lower().split() if len(t) > 2])


@query("SELECT item_id FROM benchmark WHERE contains(lower(text), 'the') OR contains(lower(text), 'les')")
def filt_or_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where(or_terms(F.col("text"), "of the les in")).select("item_id")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%1%' OR p_brand LIKE '%1%' OR p_type LIKE '%1%'")
def filt_resource(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_name").contains("1") | F.col("p_brand").contains("1") | F.col("p_type").contains("1")).select("p_partkey")


@query("SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '7'")
def filt_json_like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id", "props")


@query(f"SELECT event_id FROM events WHERE ts >= {ASOF} - INTERVAL 7 DAY")
def filt_recent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("ts >= timestamp_ntz '2024-02-01 00:00:00' - INTERVAL 7 DAYS").select("event_id")


@query(f"""SELECT doc_id, CASE WHEN {Q.any_of("t", W.RELEVANCE_NEGATIVE)} AND NOT {Q.any_of("t", W.RELEVANCE_POSITIVE)} THEN 0.2::DOUBLE WHEN {Q.any_of("t", W.RELEVANCE_POSITIVE)} THEN 0.7 WHEN {Q.count_of("t", W.RELEVANCE_WEAK)} >= 2 THEN 0.5 ELSE 0.3 END AS score
 FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def filt_relevance(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    bad, good = S.any_of(t, W.RELEVANCE_NEGATIVE), S.any_of(t, W.RELEVANCE_POSITIVE)
    return table(spark, d, "documents").select("doc_id", F.when(bad & ~good, 0.2).when(good, 0.7).when(S.count_of(t, W.RELEVANCE_WEAK) >= 2, 0.5).otherwise(0.3).alias("score"))


@query(f"SELECT page_id, round(0.5 * CASE WHEN contains(u, 'example.org') THEN 1.3 ELSE 1 END, 6) AS score FROM (SELECT page_id, lower(url) AS u, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t, length(html) AS n FROM pages) WHERE NOT contains(u, '/shorts/') AND n >= 180 AND NOT {Q.any_of('t', W.MEME_SIGNALS)}")
def filt_content(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.lower("url").alias("u"), F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("t"), F.length("html").alias("n"))
    p = p.where(~F.col("u").contains("/shorts/") & (F.col("n") >= 180) & ~S.any_of(F.col("t"), W.MEME_SIGNALS))
    return p.select("page_id", F.round(0.5 * F.when(F.col("u").contains("example.org"), 1.3).otherwise(1.0), 6).alias("score"))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(q, {Q.text(W.OFF_TOPIC)}) THEN 'off_topic_blocked' WHEN {Q.any_of('q', W.ON_TOPIC)} THEN 'on_topic' WHEN length(q) < 20 OR regexp_matches(q, {Q.text(W.GREETING)}) THEN 'greeting_short' ELSE 'general_query' END AS reason FROM (SELECT conv_id, turn, trim(lower(text)) AS q FROM conversations)")
def filt_scope(spark: SparkSession, d: str) -> DataFrame:
    q = F.trim(F.lower("text"))
    r = F.when(q.rlike(W.OFF_TOPIC), "off_topic_blocked").when(S.any_of(q, W.ON_TOPIC), "on_topic").when((F.length(q) < 20) | q.rlike(W.GREETING), "greeting_short").otherwise("general_query")
    return table(spark, d, "conversations").select("conv_id", "turn", r.alias("reason"))


@query(f"SELECT page_id, CASE WHEN {Q.any_of('lower(url)', W.ROUTE_NAMES)} OR {Q.any_of('lower(substr(html, 1, 500))', W.ROUTE_TEXTS)} THEN 'system' ELSE 'academic' END AS route FROM pages")
def filt_doc_route(spark: SparkSession, d: str) -> DataFrame:
    head = F.lower(F.substring("html", 1, 500))  # the rule is about the head of a text
    return table(spark, d, "pages").select("page_id", F.when(S.any_of(F.lower("url"), W.ROUTE_NAMES) | S.any_of(head, W.ROUTE_TEXTS), "system").otherwise("academic").alias("route"))


JOBS_SQL = """
SELECT 'wework:' || replace(lower(c_name || ':' || c_mktsegment), ' ', '-') AS id, c_mktsegment AS title, c_name AS company, 'Remote' AS location, '#' AS url, 'A' AS source, '' AS salary FROM customer
UNION ALL SELECT 'hn:' || s_suppkey, coalesce(s_name, 'Unknown'), s_name, 'Remote', '#', 'B', floor(s_acctbal)::BIGINT::VARCHAR FROM supplier
UNION ALL SELECT 'free:' || p_partkey, p_name, p_brand, 'Remote', '#', 'C', p_size::VARCHAR FROM part"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Three shapes mapped to one schema."""
    one = lambda i, t, c, s, p: [F.expr(i).alias("id"), F.expr(t).alias("title"), F.expr(c).alias("company"), F.lit("Remote").alias("location"), F.lit("#").alias("url"), F.lit(s).alias("source"), F.expr(p).alias("salary")]
    a = table(spark, d, "customer").select(*one("'wework:' || replace(lower(c_name || ':' || c_mktsegment), ' ', '-')", "c_mktsegment", "c_name", "A", "''"))
    b = table(spark, d, "supplier").select(*one("'hn:' || s_suppkey", "coalesce(s_name, 'Unknown')", "s_name", "B", "cast(floor(s_acctbal) AS string)"))
    c = table(spark, d, "part").select(*one("'free:' || p_partkey", "p_name", "p_brand", "C", "cast(p_size AS string)"))
    return a.unionByName(b).unionByName(c)


@query(JOBS_SQL)
def proj_map_source(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d)


_TAGS = [*W.SOURCE_TAGS, (["example.com"], "[Com]"), (["example.org"], "[Org]")]


@query(f"SELECT page_id, {Q.case([(Q.any_of('lower(url)', w), t) for w, t in _TAGS], Q.text(''))} AS tag FROM pages")
def proj_source_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.first_match([(S.any_of(F.lower("url"), w), t) for w, t in _TAGS], "").alias("tag"))


@query("SELECT conv_id, turn, substr(text, 1, 40) AS head FROM conversations")
def proj_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 40).alias("head"))


@query("SELECT user_id, round(acc * 100)::INT AS accuracy, (n // 50 + 1)::INT AS level, CASE WHEN acc >= 0.8 THEN 'expert' WHEN acc >= 0.5 THEN 'good' ELSE 'beginner' END AS rank_name FROM (SELECT user_id, count(*) AS n, avg((event_type = 'purchase')::INT) AS acc FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)")
def proj_case_level(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type IN ('purchase', 'error')").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "purchase").cast("int")).alias("acc"))
    return e.select("user_id", F.round(F.col("acc") * 100).cast("int").alias("accuracy"), (F.floor(F.col("n") / 50) + 1).cast("int").alias("level"), F.when(F.col("acc") >= 0.8, "expert").when(F.col("acc") >= 0.5, "good").otherwise("beginner").alias("rank_name"))


# Joins


@query("SELECT l_partkey, s_name, p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def join_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("c"))  # combined before both joins
    e = e.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return e.groupBy("l_partkey", "s_name", "p_name").agg(F.sum("c").alias("n"))


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia'")
def join_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region").where(F.lower("r_name") == "asia"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")


@query("SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def join_prereq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderpriority")


@query(f"WITH e AS ({HIERARCHY_SQL}) SELECT a.source, a.target AS parent, b.target AS grandparent FROM e a JOIN e b ON a.target = b.source")
def join_parents(spark: SparkSession, d: str) -> DataFrame:
    e = hierarchy_edges(spark, d)
    return e.withColumnRenamed("target", "parent").join(e.select(F.col("source").alias("parent"), F.col("target").alias("grandparent")), "parent").select("source", "parent", "grandparent")


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_roadmap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.sum("customers").alias("customers"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_in(spark: SparkSession, d: str) -> DataFrame:
    poor = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    large = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(poor, "o_custkey", "left_anti").join(large, "o_orderkey", "left_semi").select("o_orderkey")


@query(f"SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.ts >= {ASOF} - INTERVAL 7 DAY AND s.user_id = e.user_id)")
def anti_sent(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    sent = e.where((F.col("event_type") == "error") & (F.col("us") >= NOW_US - 7 * DAY)).select("user_id").distinct()
    return e.join(sent, "user_id", "left_anti").select("event_id")


@query("SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = v.user_id AND c.ts < v.ts AND c.ts >= v.ts - INTERVAL 24 HOUR)")
def anti_seen_user(spark: SparkSession, d: str) -> DataFrame:
    # as of each view the last click of the user: a window, which needs no pairs
    w = Window.partitionBy("user_id").orderBy("us").rowsBetween(Window.unboundedPreceding, -1)
    e = events(spark, d).withColumn("last", F.max(F.when(F.col("event_type") == "click", F.col("us"))).over(w))
    return e.where("event_type = 'view'").where(F.col("last").isNull() | (F.col("last") < F.col("us") - DAY)).select("event_id")


@query("SELECT n.doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS state FROM (SELECT doc_id, md5(text) AS h FROM documents) n LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN 'x' ELSE md5(text) END AS h FROM documents JOIN labels USING (doc_id)) o USING (doc_id)")
def anti_seen_hash(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    o = n.join(table(spark, d, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 0, "x").otherwise(F.col("h")).alias("old"))
    return n.join(o, "doc_id", "left").select("doc_id", F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("h"), "changed").otherwise("unchanged").alias("state"))


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON contains(c_name, n_nationkey::VARCHAR) GROUP BY n_name")
def join_contains(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("p"), "n_name")
    return contained(table(spark, d, "customer"), "c_name", n, "p", []).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND c_acctbal > 0")
def join_datalog(spark: SparkSession, d: str) -> DataFrame:
    from tessella.operators.datalog import Atom, body

    facts = {
        "lives": table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey"),
        "nation": table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"),
        "region": table(spark, d, "region").select("r_regionkey", "r_name"),
    }
    found = body([Atom("lives", ("C", "N")), Atom("nation", ("N", "Name", "R")), Atom("region", ("R", "Region"))], facts)
    return found.select(F.col("C").alias("c_custkey"), F.col("Name").alias("n_name"), F.col("Region").alias("r_name"))


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def self_contradict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where("event_type = 'error'").select("user_id").distinct().join(e.where("event_type = 'purchase'").select("user_id"), "user_id", "left_semi")


LEAD_SQL = "SELECT event_id, user_id, event_type, lead(event_type) OVER w AS nxt, date_diff('microsecond', ts, lead(ts) OVER w) / 3600000000.0 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)"


def followed(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the next of its user and the hours between."""
    w = Window.partitionBy("user_id").orderBy("us")
    return events(spark, d).select("event_id", "user_id", "event_type", F.lead("event_type").over(w).alias("nxt"), ((F.lead("us").over(w) - F.col("us")) / 3600000000.0).alias("gap"))


@query(f"SELECT event_id, event_type, nxt FROM ({LEAD_SQL}) WHERE gap BETWEEN 0 AND 48")
def join_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return followed(spark, d).where("gap BETWEEN 0 AND 48").select("event_id", "event_type", "nxt")


@query("SELECT e.vec_id, q.label AS intent, round(max(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS best FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) q GROUP BY ALL")
def cross_sim(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    from tessella.operators.retrieval import checked

    q = checked(e.groupBy(F.col("label").alias("intent")).agg(F.min_by("embedding", "vec_id").alias("q")))  # an example for each intent
    return e.crossJoin(q).groupBy("vec_id", "intent").agg(F.round(F.max(S.cosine(F.col("embedding"), F.col("q"))), 6).alias("best"))


# Aggregates


@query("SELECT * FROM (SELECT 'lang' AS kind, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL (SELECT 'source', source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10))")
def agg_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    count = lambda c: table(spark, d, "documents").groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("kind"), "value", "n")
    return count("lang").unionByName(count("source").orderBy(F.desc("n"), "value").limit(10))


@query("SELECT event_type AS category, count(*) AS total, sum((value > 50)::INT)::BIGINT AS correct, round(sum(value), 4) AS reviews FROM events GROUP BY event_type")
def agg_card_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("total"), F.sum((F.col("value") > 50).cast("int")).alias("correct"), F.round(F.sum("value"), 4).alias("reviews"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) < 60")
def agg_gap_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).where("n < 60")


@query("SELECT user_id, n, round(acc, 6) AS acc FROM (SELECT user_id, count(*) AS n, avg((value > 50)::INT) AS acc FROM events GROUP BY user_id) WHERE acc < 0.6 AND n >= 3 ORDER BY round(acc, 6), user_id LIMIT 10")
def agg_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") > 50).cast("int")).alias("acc"))
    return e.where("acc < 0.6 AND n >= 3").select("user_id", "n", F.round("acc", 6).alias("acc")).orderBy("acc", "user_id").limit(10)


@query("SELECT user_id, total, good, top, good * 100 >= 60 * total AND top >= 3 AS passed FROM (SELECT user_id, count(*) AS total, sum((value > 40)::INT)::BIGINT AS good, round(max(value), 6) AS top FROM events GROUP BY user_id)")
def agg_mastery_gate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.sum((F.col("value") > 40).cast("int")).alias("good"), F.round(F.max("value"), 6).alias("top"))
    return e.withColumn("passed", F.expr("good * 100 >= 60 * total AND top >= 3"))


@query("""SELECT user_id, category, total, clicks, round(latency, 4) AS latency, round(0.5 + CASE WHEN clicks > 0 THEN 0.3 ELSE 0 END + CASE WHEN latency IS NULL THEN -0.15 WHEN latency < 30000 THEN 0.2 WHEN latency < 300000 THEN 0.05 ELSE -0.05 END, 6) AS score
 FROM (SELECT user_id, event_id % 4 AS category, count(*) AS total, sum((event_type = 'click')::INT)::BIGINT AS clicks, avg(CASE WHEN value > 0 THEN value * 1000 END) AS latency FROM events GROUP BY ALL)""")
def agg_affinity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 4).alias("category")).agg(F.count(F.lit(1)).alias("total"), F.sum((F.col("event_type") == "click").cast("int")).alias("clicks"), F.avg(F.when(F.col("value") > 0, F.col("value") * 1000)).alias("latency"))
    return e.select("user_id", "category", "total", "clicks", F.round("latency", 4).alias("latency"), F.round(S.implicit_signal(F.col("clicks") > 0, F.col("latency")), 6).alias("score"))


@query("""WITH c AS (SELECT user_id, event_id % 4 AS category, avg((event_type = 'click')::INT) AS ctr FROM events GROUP BY ALL)
 SELECT user_id, round(avg(ctr), 6) AS ctr, arg_max(category, (round(ctr, 9), -category)) AS top, arg_min(category, (round(ctr, 9), category)) AS bottom FROM c GROUP BY user_id""")
def agg_ctr(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 4).alias("category")).agg(F.avg((F.col("event_type") == "click").cast("int")).alias("ctr"))
    r = F.round("ctr", 9)
    return c.groupBy("user_id").agg(F.round(F.avg("ctr"), 6).alias("ctr"), F.max_by("category", F.struct(r, -F.col("category"))).alias("top"), F.min_by("category", F.struct(r, "category")).alias("bottom"))


@query("SELECT s AS status, coalesce(n, 0) AS n FROM (VALUES ('click'), ('view'), ('refund'), ('error')) t(s) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON s = event_type")
def agg_status(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("click",), ("view",), ("refund",), ("error",)], "status string")
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(known).join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts >= {ASOF} - INTERVAL 7 DAY GROUP BY event_type")
def agg_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where(F.col("us") >= NOW_US - 7 * DAY).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT user_id) AS users, count(*) AS events, count(DISTINCT event_type) AS types FROM events")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"), F.countDistinct("event_type").alias("types"))


@query("SELECT source AS topic, count(*) AS n FROM documents GROUP BY source")
def agg_distinct_topic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS entries, sum(page_id)::BIGINT AS hits, sum(length(html))::BIGINT AS size FROM pages")
def agg_cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").agg(F.count(F.lit(1)).alias("entries"), F.sum("page_id").alias("hits"), F.sum(F.length("html").cast("long")).alias("size"))


@query("SELECT event_type, count(*) AS n, sum((value > 90)::INT)::BIGINT AS errors, round(sum(value), 4) AS total, round(avg(value)) AS mean FROM events GROUP BY event_type")
def agg_latency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 90).cast("int")).alias("errors"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value")).alias("mean"))


HEALTH_SQL = "100 - CASE WHEN cpu > 80 THEN 20 WHEN cpu > 60 THEN 10 ELSE 0 END - CASE WHEN mem > 90 THEN 20 WHEN mem > 75 THEN 10 ELSE 0 END - CASE WHEN n > 10 AND err > 0.3 THEN 20 WHEN n > 10 AND err > 0.1 THEN 10 ELSE 0 END"


@query(f"SELECT user_id, ({HEALTH_SQL})::INT AS score, CASE WHEN {HEALTH_SQL} >= 80 THEN 'healthy' WHEN {HEALTH_SQL} >= 60 THEN 'warning' WHEN {HEALTH_SQL} >= 40 THEN 'degraded' ELSE 'critical' END AS rating FROM (SELECT user_id, count(*) AS n, max(value) AS mem, avg(value) AS cpu, avg((event_type = 'error')::INT) AS err FROM events GROUP BY user_id)")
def agg_health(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("mem"), F.avg("value").alias("cpu"), F.avg((F.col("event_type") == "error").cast("int")).alias("err"))
    e = e.select("user_id", F.expr(HEALTH_SQL).cast("int").alias("score"))
    return e.withColumn("rating", F.when(F.col("score") >= 80, "healthy").when(F.col("score") >= 60, "warning").when(F.col("score") >= 40, "degraded").otherwise("critical"))


MODEL_SQL = "SELECT user_id AS model, count(*) AS calls, avg((event_type <> 'error')::INT) AS success, avg(value * 300) AS latency, sum(event_id % 100)::BIGINT AS tokens, avg(value / 10000) AS cost FROM events GROUP BY user_id"


def models(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("model")).agg(
        F.count(F.lit(1)).alias("calls"), F.avg((F.col("event_type") != "error").cast("int")).alias("success"), F.avg(F.col("value") * 300).alias("latency"),
        F.sum(F.col("event_id") % 100).alias("tokens"), F.avg(F.col("value") / 10000).alias("cost"),
    )


@query(f"SELECT model, calls, round(success, 6) AS success, round(latency, 4) AS latency, tokens, round(cost, 6) AS cost FROM ({MODEL_SQL})")
def agg_model(spark: SparkSession, d: str) -> DataFrame:
    return models(spark, d).select("model", "calls", F.round("success", 6).alias("success"), F.round("latency", 4).alias("latency"), "tokens", F.round("cost", 6).alias("cost"))


@query(f"SELECT model, score FROM (SELECT model, round(CASE WHEN calls < 3 THEN 0.5 ELSE 0.5 * success + 0.3 * greatest(0, 1 - latency / 30000) + 0.2 * greatest(0, 1 - cost / 0.01) END, 6) AS score FROM ({MODEL_SQL})) ORDER BY score DESC, model LIMIT 1")
def agg_best_model(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("calls") < 3, 0.5).otherwise(0.5 * F.col("success") + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("latency") / 30000) + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("cost") / 0.01))
    return models(spark, d).select("model", F.round(s, 6).alias("score")).orderBy(F.desc("score"), "model").limit(1)


@query("SELECT test, round(a, 6) AS a, round(b, 6) AS b, CASE WHEN a > b THEN 'A' WHEN b > a THEN 'B' ELSE 'tie' END AS winner FROM (SELECT user_id % 10 AS test, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1)")
def agg_ab(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("event_id") % 2
    e = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("test")).agg(F.avg(F.when(odd == 0, F.col("value"))).alias("a"), F.avg(F.when(odd == 1, F.col("value"))).alias("b"))
    return e.select("test", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.when(F.col("a") > F.col("b"), "A").when(F.col("b") > F.col("a"), "B").otherwise("tie").alias("winner"))


@query("SELECT lang AS query_type, source, round(avg(quality), 6) AS score, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def agg_pref(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("query_type"), "source").join(table(spark, d, "labels"), "doc_id").groupBy("query_type", "source").agg(F.round(F.avg("quality"), 6).alias("score"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS arm, round(sum(least(1, value / 100)), 4) AS successes, count(*) AS trials, round(avg(least(1, value / 100)), 6) AS reward FROM events GROUP BY 1")
def agg_bandit(spark: SparkSession, d: str) -> DataFrame:
    r = F.least(F.lit(1.0), F.col("value") / 100)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.round(F.sum(r), 4).alias("successes"), F.count(F.lit(1)).alias("trials"), F.round(F.avg(r), 6).alias("reward"))


@query("SELECT source, count(*) AS n, round(avg(quality) * 100, 4) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def agg_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality") * 100, 4).alias("quality"))


@query(f"SELECT event_type, nxt, count(*) AS n, round(avg(gap), 6) AS gap FROM ({LEAD_SQL}) WHERE gap BETWEEN 0 AND 48 GROUP BY ALL HAVING count(*) >= 2")
def agg_pattern(spark: SparkSession, d: str) -> DataFrame:
    return followed(spark, d).where("gap BETWEEN 0 AND 48").groupBy("event_type", "nxt").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 6).alias("gap")).where("n >= 2")


@query(f"SELECT user_id, round(avg(exp(-(date_diff('microsecond', last, {ASOF}) / 86400000000.0) * ln(2) / 30)), 6) AS freshness FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL) GROUP BY user_id")
def agg_freshness(spark: SparkSession, d: str) -> DataFrame:
    last = events(spark, d).groupBy("user_id", "event_type").agg(F.max("us").alias("last"))
    return last.groupBy("user_id").agg(F.round(F.avg(S.retention((F.lit(NOW_US) - F.col("last")) / float(DAY), 30)), 6).alias("freshness"))


@query("SELECT user_id, event_type, least(count(*) / 5.0, 1.0)::DOUBLE AS confidence FROM events GROUP BY ALL")
def agg_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.least(F.count(F.lit(1)) / 5.0, F.lit(1.0)).alias("confidence"))


# Windows


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS rank FROM events")
def win_rank_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))


@query(f"SELECT event_id, nxt, round(gap, 6) AS gap FROM ({LEAD_SQL}) WHERE gap BETWEEN 0 AND 48")
def win_lead_gap(spark: SparkSession, d: str) -> DataFrame:
    return followed(spark, d).where("gap BETWEEN 0 AND 48").select("event_id", "nxt", F.round("gap", 6).alias("gap"))


@query("SELECT prev, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY ALL")
def win_markov(spark: SparkSession, d: str) -> DataFrame:
    p = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("us"))
    return events(spark, d).select("event_type", p.alias("prev")).where("prev IS NOT NULL").groupBy("prev", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def win_last_n(spark: SparkSession, d: str) -> DataFrame:
    return O.first_of(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 6).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations")
def win_ffill(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("heading"))


@query("""WITH b AS (SELECT user_id, value > 50 AS ok, sum((value <= 50)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM events), r AS (SELECT user_id, g, sum(ok::INT) AS n FROM b GROUP BY ALL)
 SELECT user_id, max(n)::BIGINT AS best, arg_max(n, g)::BIGINT AS current FROM r GROUP BY user_id""")
def win_streak(spark: SparkSession, d: str) -> DataFrame:
    return O.streaks(events(spark, d), ["user_id"], "us", F.col("value") > 50)


EWMA_SQL = "SELECT user_id, round(list_reduce(list(greatest(0.0, 1 - value / 100) ORDER BY ts), lambda s, x: 0.85 * s + 0.15 * x, 0.5::DOUBLE), 6) AS speed FROM events GROUP BY user_id"


@query(EWMA_SQL)
def win_ewma(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("x", F.greatest(F.lit(0.0), 1 - F.col("value") / 100))
    speeds = Fo.fold(e, ["user_id"], ["us", "event_id"], ["x"], (0.5,), lambda s, x: (0.85 * s[0] + 0.15 * x,), tuple, "speed double")
    return speeds.withColumn("speed", F.round("speed", 6))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r <= 20")
def win_ring(spark: SparkSession, d: str) -> DataFrame:
    return O.first_of(events(spark, d), ["user_id"], [F.desc("us")], 20).select("event_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM events")
def win_dupcount(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, d).select("event_id", F.count(F.lit(1)).over(w).alias("nth"))


# Sorts, limits and top-k


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def topk_vec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("q")))
    return e.crossJoin(q).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("SELECT label, arg_max(vec_id, (s, -vec_id)) AS best, round(max(s), 6) AS score FROM (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 9) AS s FROM embeddings WHERE vec_id <> 1) GROUP BY label")
def topk_group_max(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("q")))
    s = e.where("vec_id <> 1").crossJoin(q).select("label", "vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 9).alias("s"))
    return s.groupBy("label").agg(F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("best"), F.round(F.max("s"), 6).alias("score"))


@query("SELECT event_id, round(value, 6) AS value FROM (SELECT * FROM events ORDER BY ts DESC LIMIT 2000) ORDER BY value DESC, event_id LIMIT 20")
def prelimit_recency(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).orderBy(F.desc("us")).limit(2000).orderBy(F.desc("value"), "event_id").limit(20).select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 50")
def sample_random(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("event_id"))), "event_id").limit(50)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-17' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def page_due(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderdate <= timestamp_ntz '1995-06-17 00:00:00'").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey")


@query("SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY o_custkey")
def sources_by_date(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, d, "orders").groupBy("o_custkey").agg(day(F.min("o_orderdate")).alias("first"), day(F.max("o_orderdate")).alias("last"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r > n // 5")
def evict_lru(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("us"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return e.where("r > n div 5").select("event_id")


# Set operations


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"))]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL")
def set_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))


@query("SELECT lower(trim(coalesce(nullif(url, ''), html))) AS key, min(page_id) AS page_id FROM pages GROUP BY 1")
def set_dedup_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(F.lower(F.trim(F.coalesce(F.nullif("url", F.lit("")), "html"))).alias("key")).agg(F.min("page_id").alias("page_id"))


@query("SELECT user_id, event_type, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY ALL")
def set_dedup_best(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


_VIDEO = ["https://www.youtube.com/watch?v=", "https://youtu.be/", "https://youtube.com/shorts/", "https://example.com/"]
_VIDEO_ID = "(?:youtube\\.com/(?:watch\\?v=|shorts/|embed/)|youtu\\.be/)([A-Za-z0-9_-]{11})"


@query(f"SELECT CASE WHEN v <> '' THEN 'yt:' || v ELSE u END AS key, min(event_id) AS event_id FROM (SELECT event_id, u, regexp_extract(u, '{_VIDEO_ID}', 1) AS v FROM (SELECT event_id, {_VIDEO}[event_id % 4 + 1] || substr(md5((event_id // 16)::VARCHAR), 1, 11) AS u FROM events)) GROUP BY 1")
def set_dedup_video(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat(F.element_at(F.array(*map(F.lit, _VIDEO)), (F.col("event_id") % 4 + 1).cast("int")), F.substring(F.md5(F.floor(F.col("event_id") / 16).cast("string")), 1, 11))
    v = F.regexp_extract("u", _VIDEO_ID, 1)
    return table(spark, d, "events").select("event_id", u.alias("u")).groupBy(F.when(v != "", F.concat(F.lit("yt:"), v)).otherwise(F.col("u")).alias("key")).agg(F.min("event_id").alias("event_id"))


@query("SELECT substr(text, 1, 100) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def set_dedup_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.substring("text", 1, 100).alias("key")).agg(F.min("doc_id").alias("doc_id"))  # the prefix is the identity here


@query(f"WITH e AS ({HIERARCHY_SQL}), t AS ({TRADE_SQL}) SELECT source, target FROM e UNION SELECT source, target FROM t")
def set_merge_graph(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy_edges(spark, d).unionByName(trade_edges(spark, d).select("source", "target")).distinct()


