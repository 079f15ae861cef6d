"""Queries of sources, sinks, storage, sequences, streams and the other kernels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions import words as W
from tessella.operators import quantiles as Qu
from tessella.operators import sequences as Seq
from tessella.operators import storage as St
from tessella.operators import windows as O
from tessella.operators.automaton import contained
from tessella.operators.tables import scratch
from tessella.plans import _sql as Q
from tessella.plans.registry import query
from tessella.sources import ledger as Le
from tessella.sources import readers as Rd
from tessella.sources import sinks as Si
from tessella.sources.tables import HIERARCHY_SQL, events, hierarchy_edges, table
from tessella.streaming import alerts as Al
from tessella.streaming import limits as Li

NOW_US, DAY = 1706745600000000, 86400000000.0
DAYS = "date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 86400000000.0"


# Sources and sinks


@query("SELECT count(*) AS n, min(c_custkey) AS low, max(c_custkey) AS high FROM customer")
def src_sqlite(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100")
def src_exec(spark: SparkSession, d: str) -> DataFrame:
    q = "SELECT c_custkey, c_name FROM {t} WHERE c_mktsegment = :segment AND c_acctbal > :least"
    return spark.sql(q, args={"segment": "BUILDING", "least": 100}, t=table(spark, d, "customer"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def src_json_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("props IS NOT NULL").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("SELECT conv_id, turn, parent FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS parent FROM conversations) WHERE role <> 'user'")
def src_toc_json(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "heading").otherwise("entry").alias("kind"), F.md5("text").alias("h"))
    return Rd.table_of_contents(c, "conv_id", "turn", "kind", "h").select("conv_id", "turn", "parent")


@query("SELECT c_nationkey AS category, c_name AS item, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'https://list.example/' || c_custkey END AS url FROM customer")
def src_json_nested(spark: SparkSession, d: str) -> DataFrame:
    """Lists in JSON, a hundred neighbours of a category each; every third item has no url, which comes to an empty one."""
    k = F.col("c_custkey")
    item = F.struct(F.col("c_name").alias("item"), F.when(k % 3 != 0, F.concat(F.lit("https://list.example/"), k)).alias("url"))
    nested = table(spark, d, "customer").groupBy("c_nationkey", F.floor(k / 100)).agg(F.collect_list(item).alias("items"))
    text = nested.select(F.to_json(F.struct(F.array(F.struct(F.col("c_nationkey").alias("category"), "items")).alias("categories"))).alias("j"))
    cats = text.select(F.explode(F.from_json("j", "categories array<struct<category: int, items: array<struct<item: string, url: string>>>>")["categories"]).alias("c"))
    return cats.select(F.col("c.category").alias("category"), F.explode("c.items").alias("i")).select("category", F.col("i.item").alias("item"), F.coalesce("i.url", F.lit("")).alias("url"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def src_fallback(spark: SparkSession, d: str) -> DataFrame:
    from tessella.operators.retrieval import fallback

    o = table(spark, d, "orders")
    return fallback([o.where("o_orderstatus = 'absent'").select("o_orderkey"), o.where("o_orderstatus = 'F'").select("o_orderkey"), o.select("o_orderkey")])


@query("SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'new' ELSE o_orderstatus END AS v FROM orders")
def sink_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    new = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v"))
    store = Le.Ledger(spark, scratch(spark))
    for number, batch in ((0, o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))), (1, new), (0, new.limit(0))):  # the last is a replay
        store.write(batch, number)
    return Le.latest(store.rows("k long, v string"), ["k"])


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, 'p' FROM orders WHERE o_orderstatus = 'P'")
def sink_replace_doc(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("v"))
    new = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("p").alias("v"))
    return Si.replace_documents(old, new, "l_orderkey")


@query("SELECT message, tries, CASE WHEN ok THEN 'sent' WHEN tries >= 5 THEN 'failed' ELSE 'pending' END AS state FROM (SELECT user_id * 100 + day(ts) AS message, count(*) AS tries, bool_or(event_type = 'purchase') AS ok FROM events GROUP BY 1)")
def sink_outbox(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a user and day, of which each event is an attempt: a stream whose batches an idempotent sink takes."""
    e = Li.stream_of(spark, d, "events")
    attempts = e.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("message"), (F.col("event_type") == "purchase").alias("ok"))
    return Le.states(Le.run(attempts, Le.Ledger(spark, scratch(spark)), "message long, ok boolean"), "message", "ok")


@query("SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def sink_metrics(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type").count()
    return n.select(Si.exposition(F.lit("events_total"), "type", F.col("event_type"), F.col("count")).alias("line"))


@query(f"""WITH e AS ({HIERARCHY_SQL}), n AS (SELECT id, sum(o) AS o, sum(i) AS i FROM (SELECT source AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY id)
 SELECT 'node' AS part, '{{"id":"' || id || '","out":' || o || ',"in":' || i || '}}' AS line FROM n UNION ALL SELECT 'link', '{{"source":"' || source || '","target":"' || target || '"}}' FROM e""")
def sink_graph_json(spark: SparkSession, d: str) -> DataFrame:
    return Si.graph_json(hierarchy_edges(spark, d))


@query("SELECT count(*) AS n FROM customer WHERE NOT starts_with(c_name, 'Customer#00000001')")
def sink_wh(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(~F.col("c_name").startswith("Customer#00000001")).agg(F.count(F.lit(1)).alias("n"))


# Sequences


@query("WITH t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS previous, event_type FROM events), n AS (SELECT previous, event_type, count(*) AS n FROM t WHERE previous IS NOT NULL GROUP BY ALL) SELECT previous, event_type, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY previous), 4) AS probability FROM n")
def sq_markov_matrix(spark: SparkSession, d: str) -> DataFrame:
    return Seq.transitions(events(spark, d), ["user_id"], "us", "event_type").withColumn("probability", F.round("probability", 4))


@query("WITH t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS previous, event_type FROM events), n AS (SELECT previous, event_type, count(*) AS n FROM t WHERE previous IS NOT NULL GROUP BY ALL) SELECT previous, event_type AS next FROM n QUALIFY row_number() OVER (PARTITION BY previous ORDER BY n DESC, event_type) = 1")
def sq_markov_next(spark: SparkSession, d: str) -> DataFrame:
    return Seq.likeliest(Seq.transitions(events(spark, d), ["user_id"], "us", "event_type"), "event_type")


@query("SELECT user_id, event_type, nxt, count(*) AS n, round(avg(gap), 6) AS gap, round(least(count(*) / 5.0, 1), 6) AS confidence FROM (SELECT user_id, event_type, lead(event_type) OVER w AS nxt, date_diff('microsecond', ts, lead(ts) OVER w) / 3600000000.0 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE gap BETWEEN 0 AND 48 GROUP BY ALL HAVING count(*) >= 2")
def sq_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Of each user what follows what within two days, and how sure that is."""
    w = Window.partitionBy("user_id").orderBy("us")
    e = events(spark, d).select("user_id", "event_type", F.lead("event_type").over(w).alias("nxt"), ((F.lead("us").over(w) - F.col("us")) / 3600000000.0).alias("gap")).where("gap BETWEEN 0 AND 48")
    found = e.groupBy("user_id", "event_type", "nxt").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 6).alias("gap")).where("n >= 2")
    return found.withColumn("confidence", F.round(F.least(F.col("n") / 5.0, F.lit(1.0)), 6))


@query()
def sq_thompson(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").groupBy("event_type").agg(F.sum(F.least(F.lit(1.0), F.col("value") / 100)).alias("good"), F.count(F.lit(1)).alias("n"))
    return a.withColumn("draw", Seq.beta_samples(F.col("good"), F.col("n") - F.col("good"), F.col("event_type"))).orderBy(F.desc("draw")).limit(1).select("event_type", "draw")


@query()
def sc_beta_sample(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy("user_id").agg(F.sum((F.col("value") > 50).cast("int")).alias("good"), F.count(F.lit(1)).alias("n"))
    return u.select("user_id", Seq.beta_samples(F.col("good"), F.col("n") - F.col("good"), F.col("user_id")).alias("draw"))


@query("SELECT user_id, CASE WHEN ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END AS variant FROM (SELECT DISTINCT user_id FROM events)")
def sq_ab_split(spark: SparkSession, d: str) -> DataFrame:
    even = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 8), 16, 10).cast("long") % 2 == 0
    return table(spark, d, "events").select("user_id").distinct().select("user_id", F.when(even, "A").otherwise("B").alias("variant"))


@query("SELECT o_orderkey, lead(o_orderkey, 1) OVER w AS a, lead(o_orderkey, 2) OVER w AS b, lead(o_orderkey, 3) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def sq_prefetch(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", *(F.lead("o_orderkey", i).over(w).alias(n) for i, n in enumerate("abc", 1)))


@query(f"SELECT user_id, category, round(s, 6) AS old, n AS new FROM (SELECT *, greatest(0.1, round(s * exp(-days * ln(2) / 14), 4)) AS n FROM (SELECT user_id, event_type AS category, avg(value) / 100 AS s, min({DAYS}) AS days FROM events GROUP BY ALL)) WHERE abs(n - s) > 0.001")
def sq_decay_apply(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).groupBy("user_id", F.col("event_type").alias("category")).agg((F.avg("value") / 100).alias("s"), F.min((F.lit(NOW_US) - F.col("us")) / DAY).alias("days"))
    return e.withColumn("new", S.decayed(F.col("s"), F.col("days"), "category_affinity")).where(F.abs(F.col("new") - F.col("s")) > 0.001).select("user_id", "category", F.round("s", 6).alias("old"), "new")


@query()
def sq_consolidate_all(spark: SparkSession, d: str) -> DataFrame:
    """Every document's digest, by language in three spaces; of each space the first 4000 characters."""
    space = F.when(F.col("lang").isin("de", "es"), "daily").when(F.col("lang") == "fr", "system").otherwise("academic")
    # 124 digests of 32 and a line end fill a space
    ranked = table(spark, d, "documents").select(space.alias("space"), "doc_id", F.md5("text").alias("h"))
    n = ranked.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    first = O.first_of(ranked, ["space"], ["doc_id"], 124).groupBy("space").agg(F.array_sort(F.collect_list(F.struct("doc_id", "h"))).alias("hs"))
    return n.join(first, "space").select("space", "n", F.md5(F.substring(F.array_join(F.col("hs.h"), "\n"), 1, 4000)).alias("digest"))


@query("SELECT event_id, ts < TIMESTAMP '2024-02-01' - INTERVAL 14 DAY AS archived FROM events")
def sq_archive(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", (F.col("us") < NOW_US - int(14 * DAY)).alias("archived"))


# Storage

_LOG = "SELECT user_id AS k, ts AS seq, value AS v, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op FROM events"
_LAST = f"SELECT k, arg_max(op, seq) AS op, arg_max(v, seq) AS v FROM ({_LOG}) GROUP BY k"


def kv_log(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("user_id").alias("k"), F.col("us").alias("seq"), F.col("value").alias("v"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"))


@query(f"SELECT k, round(v, 6) AS v FROM ({_LAST}) WHERE op = 'PUT'")
def st_lsm_scan(spark: SparkSession, d: str) -> DataFrame:
    return St.live(kv_log(spark, d), "k", "seq", "op", "v").select("k", F.round("v", 6).alias("v"))


@query(f"SELECT k, round(v, 6) AS v FROM ({_LAST}) WHERE op = 'PUT' AND k = 7")
def st_lsm_get(spark: SparkSession, d: str) -> DataFrame:
    return St.live(kv_log(spark, d).where("k = 7"), "k", "seq", "op", "v").select("k", F.round("v", 6).alias("v"))


@query(f"SELECT k, op FROM ({_LAST})")
def st_lsm_put(spark: SparkSession, d: str) -> DataFrame:
    return St.latest(kv_log(spark, d), "k", "seq", "op")


@query(f"SELECT k FROM ({_LAST}) WHERE op = 'DELETE'")
def st_lsm_del(spark: SparkSession, d: str) -> DataFrame:
    return St.latest(kv_log(spark, d), "k", "seq", "op").where("op = 'DELETE'").select("k")


@query(f"SELECT k, op, round(v, 6) AS v FROM ({_LAST})")
def st_lsm_compact(spark: SparkSession, d: str) -> DataFrame:
    return St.compact(kv_log(spark, d), "k", "seq", "op", "v", drop_deletes=False).select("k", "op", F.round("v", 6).alias("v"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000")
def st_lsm_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey BETWEEN 1000 AND 2000").select("o_orderkey", "o_custkey")


@query(f"SELECT k, round(v, 6) AS v FROM ({_LAST}) WHERE op = 'PUT'")
def st_wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """What log files in the shared folder leave of each key; a line that a crash cut off is passed over."""
    folder = scratch(spark)
    line = F.to_json(F.struct("k", "seq", "v", "op"))
    torn = F.when(F.pmod(F.xxhash64("seq"), F.lit(50)) == 0, F.concat(line, F.lit("\n"), F.expr("substring(to_json(struct(k, seq, v, 'DELETE' AS op)), 1, 20)"))).otherwise(line)
    kv_log(spark, d).select(torn.alias("line")).write.text(folder)
    schema = "k long, seq long, v double, op string, _broken string"
    log = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(folder)
    return St.live(log.where("_broken IS NULL AND op IS NOT NULL"), "k", "seq", "op", "v").select("k", F.round("v", 6).alias("v"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r <= 100")
def st_queue(spark: SparkSession, d: str) -> DataFrame:
    return O.first_of(events(spark, d), ["user_id"], [F.desc("us")], 100).select("event_id")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)) AS maybe FROM events GROUP BY event_type")
def st_bloom(spark: SparkSession, d: str) -> DataFrame:
    """Events of users that a set holds.  The planner may filter the large side by a Bloom filter of the set; the join makes the answer exact."""
    e = table(spark, d, "events")
    some = e.where("event_type = 'purchase' AND value > 150").select("user_id").distinct().withColumn("maybe", F.lit(1))
    return e.join(some, "user_id", "left").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("maybe").alias("maybe"))


# Streams, as batch queries of equal results


_QUICK = "1704067200000000 + (epoch_us(ts) - 1704067200000000) // 40000"
_OPEN = "list_filter(s.kept, lambda t: t > x.us - 60000000)"


@query(f"""WITH e AS (SELECT user_id, event_id, {_QUICK} AS us FROM events),
 o AS (SELECT user_id, list({{'us': us, 'id': event_id, 'kept': []::BIGINT[], 'ids': []::BIGINT[]}} ORDER BY us, event_id) AS l FROM e GROUP BY user_id),
 f AS (SELECT user_id, list_reduce(l, lambda s, x: {{'us': x.us, 'id': x.id, 'kept': CASE WHEN len({_OPEN}) < 30 THEN list_append({_OPEN}, x.us) ELSE {_OPEN} END, 'ids': CASE WHEN len({_OPEN}) < 30 THEN list_append(s.ids, x.id) ELSE s.ids END}},
  {{'us': 0::BIGINT, 'id': 0::BIGINT, 'kept': []::BIGINT[], 'ids': []::BIGINT[]}}).ids AS ids FROM o)
 SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS demand, event_id IN (SELECT unnest(ids) FROM f) AS accepted FROM e""")
def sm_ratelimit(spark: SparkSession, d: str) -> DataFrame:
    """Requests in quick succession: how many a user made in the last minute, and whether the sliding log accepts each.

    The decisions come from a stream over the events, with its state in the state store.
    """
    zero = 1704067200000000
    quick = lambda us: zero + F.floor((us - zero) / 40000)
    live = Li.stream_of(spark, d, "events")
    requests = live.select("event_id", "user_id", F.timestamp_micros(quick(F.unix_micros(F.col("ts").cast("timestamp"))).cast("long")).alias("ts"))
    decided = Li.run_to_table(Li.sliding_log(requests), scratch(spark))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, 0)
    return decided.select("event_id", F.count(F.lit(1)).over(w).alias("demand"), "accepted")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY ALL")
def sm_metrics(spark: SparkSession, d: str) -> DataFrame:
    from tessella.streaming.windows import metrics

    m = metrics(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return m.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"))


@query("WITH s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, g")
def sm_idle(spark: SparkSession, d: str) -> DataFrame:
    from tessella.streaming.windows import sessions

    s = sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("SELECT event_id FROM events v WHERE event_type = 'view' AND ts < TIMESTAMP '2024-02-01' - INTERVAL 48 HOUR AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = v.user_id AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 48 HOUR)")
def sm_skip_mark(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us").rowsBetween(0, Window.unboundedFollowing)
    e = events(spark, d).withColumn("next", F.min(F.when(F.col("event_type") == "click", F.col("us"))).over(w))
    return e.where((F.col("event_type") == "view") & (F.col("us") < NOW_US - int(2 * DAY)) & (F.col("next").isNull() | (F.col("next") > F.col("us") + int(2 * DAY)))).select("event_id")


_SLOW = "(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 400)"
#: The samples of each kind of event: metric and value.
_SAMPLES = {
    "error": [("restart", "1.0"), ("up", "CASE WHEN value > 120 THEN 0.0 ELSE 1.0 END")],
    "signup": [("memory", "0.8 + value / 600"), ("disk", "value / 400")],
    "purchase": [("cpu", "80 + value / 5")],
    "view": [("response", "value / 25")],
    "click": [("search", "value / 60")],
}
_G, _LN = Qu.factor(), math.log(Qu.factor())
_NUMBER = f"CASE WHEN value > 1e-9 THEN ceil(ln(value) / {_LN!r})::BIGINT + 100000 ELSE 0 END"
_MIDDLE = f"CASE WHEN b = 0 THEN 0.0 ELSE pow({_G!r}, b - 100000) * {2 / (1 + _G)!r} END"


def samples(e: DataFrame) -> DataFrame:
    """ts, instance, metric, value of events, three instances, in less than two hours."""
    zero = 1704067200000000
    kinds = F.create_map(*(x for kind, found in _SAMPLES.items() for x in (F.lit(kind), F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(v).cast("double").alias("value")) for m, v in found)))))
    at = F.timestamp_micros((zero + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - zero) / 400)).cast("long"))
    rows = e.select(at.alias("ts"), (F.col("user_id") % 3).alias("instance"), F.explode(F.element_at(kinds, F.col("event_type"))).alias("s"))
    return rows.select("ts", "instance", "s.metric", "s.value")


def _alert_sql() -> str:
    made = " UNION ALL ".join(f"SELECT us, instance, '{m}' AS metric, ({v})::DOUBLE AS value FROM e WHERE event_type = '{k}'" for k, found in _SAMPLES.items() for m, v in found)
    rules = ", ".join(f"('{r.name}', '{r.metric}', '{r.kind}', {r.minutes}, {r.above}, {float(r.threshold)}, {r.patience}, '{r.severity}')" for r in Al.RULES)
    return f"""WITH e AS (SELECT *, {_SLOW} AS us, user_id % 3 AS instance FROM events), s AS ({made}),
 r(rule, metric, kind, minutes, above, threshold, patience, severity) AS (VALUES {rules}),
 w AS (SELECT rule, kind, instance, value, us // 60000000 + k AS m FROM s JOIN r USING (metric), range(1, 61) g(k) WHERE k <= minutes),
 p AS (SELECT rule, instance, m, {_NUMBER} AS b, count(*) AS n FROM w WHERE kind = 'p95' GROUP BY ALL),
 q AS (SELECT *, sum(n) OVER (PARTITION BY rule, instance, m ORDER BY b) AS seen, floor(0.95::DOUBLE * (sum(n) OVER (PARTITION BY rule, instance, m) - 1)) AS place FROM p),
 v AS (SELECT rule, instance, m, CASE WHEN any_value(kind) = 'count' THEN count(*)::DOUBLE ELSE round(avg(value), 9) END AS value FROM w WHERE kind <> 'p95' GROUP BY ALL
  UNION ALL SELECT rule, instance, m, {_MIDDLE} FROM (SELECT rule, instance, m, min(b) AS b FROM q WHERE seen > place GROUP BY ALL)),
 x AS (SELECT *, m - row_number() OVER (PARTITION BY rule, instance ORDER BY m) AS run FROM v JOIN r USING (rule) WHERE CASE WHEN above THEN value > threshold ELSE value < threshold END)
 SELECT rule, severity, instance, m * 60 AS minute, round(value, 6) AS value, CASE WHEN m - min(m) OVER (PARTITION BY rule, instance, run) >= patience THEN 'firing' ELSE 'pending' END AS state FROM x"""


@query(_alert_sql())
def sm_alert(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules, minute by minute: restarts, memory, CPU, disk, a service down, and both latencies."""
    found = Al.judged(Al.evaluated(samples(table(spark, d, "events"))))
    return found.select("rule", "severity", "instance", F.unix_seconds("at").alias("minute"), F.round("value", 6).alias("value"), "state")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def sm_p95(spark: SparkSession, d: str) -> DataFrame:
    found = Qu.exact(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", *(F.round(n, 6).alias(n) for n in ("p50", "p95")))


# Other kernels


@query("SELECT user_id % 10 AS round, event_id % 2 AS contestant, round(avg(value), 6) AS latency, count(*) FILTER (event_type = 'purchase') AS successes FROM events GROUP BY ALL")
def x_round_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("round"), (F.col("event_id") % 2).alias("contestant")).agg(F.round(F.avg("value"), 6).alias("latency"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("successes"))


@query("SELECT user_id, event_type AS winner, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def x_vote_tally(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("w")).select("user_id", F.col("w.event_type").alias("winner"), (-F.col("w.m")).alias("n"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS acks FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag <> 'R') >= count(*) // 2 + 1")
def x_quorum(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_returnflag") != "R").cast("long")).alias("acks"), F.count(F.lit(1)).alias("n"))
    return li.where("acks >= n div 2 + 1").select("l_orderkey", "acks")


_CLASSES = ", ".join(f"{Q.any_of('t', w)} AS {n}" for w, n in W.ERROR_CLASSES)


@query("SELECT lang, coalesce(c, 'UNKNOWN') AS class FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN (" + " UNION ".join(f"SELECT DISTINCT lang AS l, {Q.text(n)} AS c FROM documents WHERE {Q.any_of('lower(text)', w)}" for w, n in W.ERROR_CLASSES) + ") ON lang = l")
def x_error_pattern(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.lower("text").alias("t"))
    words = spark.createDataFrame([(w, n) for ws, n in W.ERROR_CLASSES for w in ws], "word string, class string")
    some = contained(docs, "t", words, "word", ["lang"]).select("lang", "class").distinct()
    none = docs.select("lang").distinct().join(some.select("lang"), "lang", "left_anti").select("lang", F.lit("UNKNOWN").alias("class"))
    return some.unionByName(none)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)::INT AS place FROM orders")
def x_dag_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")).alias("place"))


# Pass-through of SQL


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        table(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(text)


SQLPASS = {
    "sqlpass_agg": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sqlpass_join": "SELECT n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sqlpass_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "sqlpass_semi": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "sqlpass_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "sqlpass_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 590",
    "sqlpass_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "sqlpass_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "sqlpass_union": "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "sqlpass_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sqlpass_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40",
    "sqlpass_window": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2",
    "sqlpass_topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25",
    "sqlpass_like": "SELECT p_partkey FROM part WHERE p_type LIKE '%A%' AND p_name LIKE '%old%'",
    "sqlpass_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sqlpass_date": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
}
for _name, _text in SQLPASS.items():
    query(_text, _name)(lambda spark, d, text=_text: _sql(spark, d, text))
