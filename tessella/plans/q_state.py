"""Queries of operators that keep state: profiles, reviews, caches, schedules, simulations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import folds as Fo
from tessella.operators import retrieval as R
from tessella.operators import windows as O
from tessella.operators.automaton import contained
from tessella.plans import _samples as X
from tessella.plans import _sql as Q
from tessella.plans.registry import query
from tessella.sources.tables import events, table

NOW_US, DAY = 1706745600000000, 86400000000
ASOF = "TIMESTAMP '2024-02-01'"


def flag(c: Column) -> Column:
    return c.cast("int")


# Filters, joins and aggregates


_ZERO = "CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END"


@query(f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, v, list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) AS score FROM (SELECT vec_id, {_ZERO} AS v FROM embeddings)) WHERE len(list_filter(v, lambda x: x <> 0)) > 0 AND score > 0.1")
def filt_zero_vec(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose vector is not all zero and whose score is above 0.1; every seventh vector is zero here."""
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("q")))
    v = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    rows = e.select("vec_id", v.alias("v")).where(F.exists("v", lambda x: x != 0)).crossJoin(q)
    return rows.select("vec_id", F.round(S.cosine(F.col("v"), F.col("q")), 6).alias("score")).where("score > 0.1")


@query("SELECT a.n_name AS trigger, b.n_name AS topic FROM nation a JOIN nation b ON contains(lower(a.n_name), lower(b.n_name)) OR contains(lower(b.n_name), lower(a.n_name))")
def join_contains_bi(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.lower("n_name").alias("l"), F.col("n_name").alias("trigger"))
    b = a.select(F.col("l").alias("p"), F.col("trigger").alias("topic"))
    inside = contained(a, "l", b, "p", ["trigger"]).select("trigger", "topic")
    return inside.unionByName(inside.select(F.col("topic").alias("trigger"), F.col("trigger").alias("topic"))).distinct()


_USED = "(user_id % 3 = 0 OR user_id % 3 = 1 AND ts < TIMESTAMP '2024-01-15')"


@query(f"""SELECT n_name AS agent, n_regionkey <> 4 AS enabled, coalesce(calls, 0) AS calls, n_regionkey <> 4 AND (last IS NULL OR last < {ASOF} - INTERVAL 7 DAY) AS unused, CASE WHEN n_regionkey = 4 THEN NULL WHEN last IS NULL THEN 'never called' WHEN last < {ASOF} - INTERVAL 7 DAY THEN 'last called ' || strftime(last, '%Y-%m-%d') END AS reason
 FROM nation LEFT JOIN (SELECT user_id, count(*) AS calls, max(ts) AS last FROM events WHERE {_USED} GROUP BY 1) ON n_nationkey = user_id""")
def agg_usage(spark: SparkSession, d: str) -> DataFrame:
    """Calls of every registered agent; of the enabled ones those never called or not in a week are unused."""
    k = F.col("user_id") % 3
    u = table(spark, d, "events").where((k == 0) | ((k == 1) & (F.col("ts") < F.expr("timestamp_ntz '2024-01-15 00:00:00'")))).groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.max("ts").alias("last"))
    j = table(spark, d, "nation").join(u, F.col("n_nationkey") == F.col("user_id"), "left")
    enabled, stale = F.col("n_regionkey") != 4, F.col("last") < F.expr("timestamp_ntz '2024-01-25 00:00:00'")
    reason = F.when(~enabled, None).when(F.col("last").isNull(), "never called").when(stale, F.concat(F.lit("last called "), F.date_format("last", "yyyy-MM-dd")))
    return j.select(F.col("n_name").alias("agent"), enabled.alias("enabled"), F.coalesce("calls", F.lit(0)).alias("calls"), (enabled & (F.col("last").isNull() | stale)).alias("unused"), reason.alias("reason"))


_WORDS = "list_distinct(string_split_regex(lower(text), '\\s+'))"


@query(f"""WITH w AS (SELECT item_id, {_WORDS} AS ws FROM benchmark UNION ALL SELECT item_id + 100000, list_filter({_WORDS}, lambda x, i: i % (5 + item_id % 5) <> 0) FROM benchmark),
 p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.ws, b.ws))::DOUBLE / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) AS j FROM w a JOIN w b ON a.item_id < b.item_id) SELECT a, b, round(j, 6) AS j, j > 0.8 AS same_question FROM p WHERE j > 0.7""")
def set_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Texts and copies of them without every fifth to ninth word: pairs above 0.7, and whether above 0.8."""
    from tessella.operators.similarity import jaccard_pairs

    w = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), "\\s+")).alias("ws"))
    less = w.select((F.col("item_id") + 100000).alias("item_id"), F.filter("ws", lambda x, i: (i + 1) % (5 + F.col("item_id") % 5) != 0).alias("ws"))
    return jaccard_pairs(w.unionByName(less), "item_id", "ws", 0.7).select("a", "b", F.round("j", 6).alias("j"), (F.col("j") > 0.8).alias("same_question"))


# Retrieval


_NOISY = "list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i <= (vec_id // 20) % 3 * 8 THEN 0.0 ELSE x END)"


@query(f"""WITH q AS (SELECT vec_id AS query, 't' || vec_id AS t, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id + 1000000 AS entry, CASE WHEN vec_id % 80 = 0 THEN 'T' ELSE 'other ' END || vec_id || ' ' AS text, {_NOISY} AS v, label / 10.0 AS tier FROM embeddings),
 e AS (SELECT query, min(entry) AS entry FROM q JOIN c ON trim(lower(text)) = t GROUP BY query),
 n AS (SELECT query, arg_max(entry, (s, -entry)) AS entry, max(s) AS s, arg_max(tier, (s, -entry)) AS tier FROM (SELECT query, entry, tier, round(list_cosine_similarity(q, v), 9) AS s FROM q, c WHERE query NOT IN (SELECT query FROM e)) GROUP BY query),
 f AS (SELECT query, entry, 1.0::DOUBLE AS similarity, 'exact' AS tier, 1.0::DOUBLE AS effective FROM e UNION ALL SELECT query, entry, round(s, 6), 'semantic', round(s * (0.7 + 0.3 * tier), 6) FROM n WHERE s >= 0.92)
 SELECT * FROM f UNION ALL SELECT query, NULL, NULL, 'miss', NULL FROM q WHERE query NOT IN (SELECT query FROM f)""")
def ret_sem_cache(spark: SparkSession, d: str) -> DataFrame:
    """Answers of equal text, else of the nearest cached question, else none."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.concat(F.lit("t"), "vec_id").alias("q_text"), F.col("embedding").alias("q"))
    text = F.concat(F.when(F.col("vec_id") % 80 == 0, "T").otherwise("other "), "vec_id", F.lit(" "))
    noisy = F.transform("embedding", lambda x, i: F.when(i < F.floor(F.col("vec_id") / 20) % 3 * 8, x * 0).otherwise(x))
    c = e.select((F.col("vec_id") + 1000000).alias("entry"), text.alias("text"), noisy.alias("vector"), (F.col("label") / 10.0).alias("tier_weight"))
    found = R.cached_answers(q, c).select("query", "entry", F.round("similarity", 6).alias("similarity"), "tier", F.round("effective", 6).alias("effective"))
    return q.select("query").join(found, "query", "left").withColumn("tier", F.coalesce("tier", F.lit("miss")))


@query(f"""WITH c AS (SELECT event_type, user_id, max(ts) AS used, min(ts) AS made FROM events GROUP BY ALL), v AS (SELECT * FROM c WHERE user_id % 7 <> 3 AND made >= {ASOF} - INTERVAL 31 DAY - INTERVAL 6 HOUR)
 SELECT event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY used DESC, user_id) AS r FROM v) WHERE r <= 50""")
def ret_cache_evict(spark: SparkSession, d: str) -> DataFrame:
    """Entries that stay: not of the invalidated context, not expired, and of each cache the last used ones."""
    c = events(spark, d).groupBy("event_type", "user_id").agg(F.max("us").alias("used"), F.min("us").alias("made"))
    c = c.where((F.col("user_id") % 7 != 3) & (F.col("made") >= NOW_US - 31 * DAY - DAY // 4))
    return O.first_of(c, ["event_type"], [F.desc("used"), "user_id"], 50).select("event_type", "user_id")


_RESULTS = "SELECT CASE WHEN page_id % 11 = 0 THEN '' ELSE url END AS url, 'a' AS src, page_id * 13 % 97 / 100.0 AS score, page_id AS pos FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT url, 'b', 0.5, page_id + 1000000 FROM pages UNION ALL SELECT 'https://c.example/' || (page_id % 9), 'c', NULL, page_id + 2000000 FROM pages"


@query(f"SELECT url, src, round(score, 6) AS score, row_number() OVER (ORDER BY coalesce(score, 0) DESC, pos)::INT AS place FROM (SELECT url, arg_min(src, pos) AS src, arg_min_null(score, pos) AS score, min(pos) AS pos FROM ({_RESULTS}) WHERE url <> '' GROUP BY url) ORDER BY place LIMIT 200")
def ret_federated(spark: SparkSession, d: str) -> DataFrame:
    """Results of three sources: of each url the first, by score; without a url or a score they come to nothing or last."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    a = p.where(k % 3 != 0).select(F.when(k % 11 == 0, "").otherwise(F.col("url")).alias("url"), F.lit("a").alias("src"), (k * 13 % 97 / 100.0).alias("score"), k.alias("pos"))
    b = p.select("url", F.lit("b").alias("src"), F.lit(0.5).alias("score"), (k + 1000000).alias("pos"))
    c = p.select(F.concat(F.lit("https://c.example/"), (k % 9).cast("string")).alias("url"), F.lit("c").alias("src"), F.lit(None).cast("double").alias("score"), (k + 2000000).alias("pos"))
    first = F.min_by(F.struct("src", "score"), "pos").alias("f")
    best = a.unionByName(b).unionByName(c).where("url <> ''").groupBy("url").agg(first, F.min("pos").alias("pos"))
    best = best.select("url", "f.src", F.coalesce("f.score", F.lit(0.0)).alias("order"), F.round("f.score", 6).alias("score"), "pos").orderBy(F.desc("order"), "pos").limit(200)
    return best.select("url", "src", "score", F.row_number().over(Window.orderBy(F.desc("order"), "pos")).alias("place"))  # at most 200 rows


# Profiles, reviews and memories


_TIME = "(value * 100)"


@query(f"""WITH t AS (SELECT user_id, list({{'speed': 0.5::DOUBLE, 'ok': value > 50, 'time': {_TIME}::DOUBLE, 'now': 0, 'best': 0}} ORDER BY ts, event_id) AS l, count(*) AS asked, sum((value > 50)::INT)::BIGINT AS correct FROM events GROUP BY user_id),
 f AS (SELECT user_id, asked, correct, list_reduce(l, lambda s, x: {{'speed': 0.85 * s.speed + 0.15 * CASE WHEN x.ok THEN greatest(0.0, 1 - x.time / 20000) ELSE 0.0 END, 'ok': x.ok, 'time': x.time, 'now': CASE WHEN x.ok THEN s.now + 1 ELSE 0 END, 'best': greatest(s.best, CASE WHEN x.ok THEN s.now + 1 ELSE 0 END)}}, {{'speed': 0.5::DOUBLE, 'ok': false, 'time': 0.0::DOUBLE, 'now': 0, 'best': 0}}) AS s FROM t),
 p AS (SELECT user_id, event_type AS topic, count(*) AS n, sum((value > 50)::INT) AS c FROM events GROUP BY ALL),
 w AS (SELECT user_id, array_to_string(list(topic || ':' || printf('%.3f', floor(c / n::DOUBLE * 1000 + 0.5) / 1000) ORDER BY topic), ',') AS strengths, coalesce(array_to_string(list(topic || ':' || printf('%.1f', 4.0 - 0.5 * c) ORDER BY topic) FILTER (c < 8), ','), '') AS weak FROM p GROUP BY user_id)
 SELECT user_id, asked, correct, round(s.speed, 6) AS speed, s.now::INT AS current_streak, s.best::INT AS best_streak, strengths, weak FROM f JOIN w USING (user_id)""")
def sq_quiz_update(spark: SparkSession, d: str) -> DataFrame:
    """Profiles after all answers: speed, streaks, accuracy by topic, and weak areas, which begin at 4 and lose a half by each right answer."""
    e = events(spark, d).withColumn("ok", F.col("value") > 50).withColumn("time", F.col("value") * 100)

    def step(s: tuple, ok: bool, time: float) -> tuple:
        speed, now, best = s
        signal = max(0.0, 1 - time / 20000) if ok else 0.0
        now = now + 1 if ok else 0
        return 0.85 * speed + 0.15 * signal, now, max(best, now)

    folded = Fo.fold(e, ["user_id"], ["us", "event_id"], ["ok", "time"], (0.5, 0, 0), step, tuple, "speed double, now int, best int")
    topics = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(flag(F.col("ok"))).alias("c"))
    said = lambda form, x: F.concat("event_type", F.lit(":"), F.format_string(form, x))
    listed = lambda x: F.array_join(F.array_sort(F.collect_list(x)), ",")  # noqa: E731  one of each topic
    p = topics.groupBy("user_id").agg(
        F.sum("n").alias("asked"), F.sum("c").alias("correct"), listed(said("%.3f", F.col("c") / F.col("n"))).alias("strengths"), listed(F.when(F.col("c") < 8, said("%.1f", 4.0 - 0.5 * F.col("c")))).alias("weak"),
    )
    return p.join(folded, "user_id").select("user_id", "asked", "correct", F.round("speed", 6).alias("speed"), F.col("now").alias("current_streak"), F.col("best").alias("best_streak"), "strengths", "weak")


_RATED = "CASE WHEN value > 70 THEN 4.0::DOUBLE WHEN value > 40 THEN 3.0 ELSE 1.0 END"
_GROWN = "s.s * (1 + 1.49 * pow(s.d, -0.14) * pow(s.s, 0.4) * (exp((1 - exp(ln(0.9) * s.e / s.s)) * 0.6) - 1))"
_CLAMP = "greatest({0}, least({1}, {2}))"


@query(f"""WITH o AS (SELECT user_id, event_type, list({{'s': 1.0::DOUBLE, 'd': 5.0::DOUBLE, 'e': CASE WHEN prev IS NULL THEN 0.0 ELSE date_diff('microsecond', prev, ts) / 86400000000.0 END, 'r': {_RATED}, 'right': (value > 40)::INT}} ORDER BY ts, event_id) AS l FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events) GROUP BY ALL),
 f AS (SELECT user_id, event_type, len(l) AS reviews, list_sum(list_transform(l, lambda x: x.right))::BIGINT AS correct, list_reduce(list_transform(l, lambda x: x), lambda a, x: {{
  's': round({_CLAMP.format(0.1, 3650.0, "CASE WHEN x.r = 1 THEN 0.94 * pow(a.s, -0.05) * (exp(0.1 * 0.34) - 1) WHEN x.r = 3 THEN G ELSE G * 2.4 END".replace("G", _GROWN.replace("s.e", "x.e").replace("s.s", "a.s").replace("s.d", "a.d")))}, 2),
  'd': round({_CLAMP.format(1.0, 10.0, "CASE WHEN x.r = 1 THEN a.d + 2.18 * (1 - a.d / 10) WHEN x.r = 3 THEN a.d - 2.18 * (a.d / 10 - 0.5) ELSE a.d - 2.18 * a.d / 10 END")}, 2), 'e': x.e, 'r': x.r, 'right': x.right}}, {{'s': 1.0::DOUBLE, 'd': 5.0::DOUBLE, 'e': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'right': 0}}) AS s FROM o)
 SELECT user_id, event_type, reviews, correct, round(s.s, 2) AS stability, round(s.d, 2) AS difficulty, least(365, round(s.s))::INT AS due_in FROM f""")
def sq_fsrs_review(spark: SparkSession, d: str) -> DataFrame:
    """Cards after all reviews: stability and difficulty are kept to two digits between reviews; days since the last one count."""
    r = F.when(F.col("value") > 70, 4).when(F.col("value") > 40, 3).otherwise(1)
    w = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")
    e = events(spark, d).withColumn("r", r).withColumn("days", F.coalesce((F.col("us") - F.lag("us").over(w)) / DAY, F.lit(0.0)))
    after = S.fsrs_step()

    def step(s: tuple, rating: int, days: float) -> tuple:
        stability, difficulty = after(s[0], s[1], rating, days)
        return S.half_up(stability, 2), S.half_up(difficulty, 2), s[2] + 1, s[3] + (rating > 1)

    cards = Fo.fold(e, ["user_id", "event_type"], ["us", "event_id"], ["r", "days"], (1.0, 5.0, 0, 0), step, tuple, "stability double, difficulty double, reviews long, correct long")
    return cards.withColumn("due_in", F.least(F.lit(365), F.round("stability").cast("int")))


SPACES = ("daily", "system", "academic")
_TAGS = ["discord", "user-memory,chat", "system", "runtime error", "changelog", "paper", ""]
_SPACE = "CASE WHEN contains(tags, 'discord') OR contains(tags, 'user-memory') THEN 'daily' WHEN contains(tags, 'system') OR contains(tags, 'error') OR contains(tags, 'log') THEN 'system' ELSE 'academic' END"


@query(f"SELECT space, count(*) AS n, md5(substr(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id), 1, 4000)) AS digest FROM (SELECT *, {_SPACE} AS space FROM (SELECT doc_id, text, {X.pick_sql(_TAGS, 'doc_id')} AS tags FROM documents)) GROUP BY space")
def sq_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """Memories by their tags in three spaces; of each space the first 4000 characters of all, one a line."""
    tags = X.pick(_TAGS, F.col("doc_id"))
    daily, system = S.any_of(tags, ["discord", "user-memory"]), S.any_of(tags, ["system", "error", "log"])
    m = table(spark, d, "documents").select("doc_id", F.when(daily, "daily").when(system, "system").otherwise("academic").alias("space"), F.substring(F.coalesce("text", F.lit("")), 1, 4000).alias("t"))
    return consolidated(m)


def consolidated(memories: DataFrame, most: int = 4000) -> DataFrame:
    """space, n, digest of memories (doc_id, space, t); every memory ends a line, so ``most`` of them fill a space."""
    first = reduce(DataFrame.unionByName, [memories.where(F.col("space") == s).orderBy("doc_id").limit(most) for s in SPACES])
    before = Window.partitionBy("space").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("at", F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0))).where(F.col("at") < most)
    joined = first.groupBy("space").agg(F.array_sort(F.collect_list(F.struct("doc_id", "t"))).alias("ts"))
    n = memories.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    return n.join(joined, "space").select("space", "n", F.md5(F.substring(F.array_join("ts.t", "\n"), 1, most)).alias("digest"))


# Time to live


def _accept_sql(key: str, ttl: int, us: str = "epoch_us(ts)") -> str:
    """Accepted events of each key as a fold: those at least a time to live after the last accepted one."""
    start = "{'last': -9000000000000000::BIGINT, 'ids': []::BIGINT[]}"
    one = f"{{'last': {us}, 'ids': [event_id::BIGINT]}}"
    step = f"CASE WHEN x.last - s.last >= {ttl} THEN {{'last': x.last, 'ids': list_concat(s.ids, x.ids)}} ELSE s END"
    return f"SELECT {key}, list_reduce(list({one} ORDER BY ts, event_id), lambda s, x: {step}, {start}).ids AS ids FROM events GROUP BY ALL"


@query(f"SELECT user_id, event_type, unnest(ids) AS event_id FROM ({_accept_sql('user_id, event_type', 5_000_000, '((epoch_us(ts) - 1704067200000000) // 40000)')})")
def st_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Calls that start: others within five seconds of one that started share its result."""
    quick = events(spark, d).withColumn("us", F.floor((F.col("us") - 1704067200000000) / 40000))  # calls in quick succession
    return Fo.accepted(quick, ["user_id", "event_type"], "us", "event_id", 5_000_000).select("user_id", "event_type", "event_id")


@query(f"SELECT user_id, event_type, len(ids)::INT AS accepted FROM ({_accept_sql('user_id, event_type', DAY)})")
def sm_dedup_ttl(spark: SparkSession, d: str) -> DataFrame:
    return _counted(Fo.accepted(events(spark, d), ["user_id", "event_type"], "us", "event_id", DAY), "user_id", "event_type")


def _counted(kept: DataFrame, *by: str) -> DataFrame:
    return kept.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("accepted"))


@query(f"SELECT event_type, len(list_reduce(list({{'last': m, 'n': [1]}} ORDER BY m), lambda s, x: CASE WHEN x.last - s.last >= {DAY} THEN {{'last': x.last, 'n': list_concat(s.n, x.n)}} ELSE s END, {{'last': -9000000000000000::BIGINT, 'n': []::INT[]}}).n)::INT AS accepted FROM (SELECT DISTINCT event_type || user_id % 40 AS event_type, epoch_us(ts) // 60000000 * 60000000 AS m FROM events) GROUP BY event_type")
def x_topic_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Topics taken up again a day after the last time, by the minute."""
    topic = F.concat("event_type", (F.col("user_id") % 40).cast("string"))
    minutes = events(spark, d).select(topic.alias("event_type"), (F.floor(F.col("us") / 60_000_000) * 60_000_000).alias("m")).distinct()
    return _counted(Fo.accepted(minutes.withColumn("k", F.lit(0)), ["event_type"], "m", "k", DAY), "event_type")


@query(f"SELECT user_id, md5(lower(trim(event_type))) AS q, len(ids)::INT AS accepted FROM ({_accept_sql('user_id, event_type', 3_600_000_000)})")
def x_user_query_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("q", F.md5(F.lower(F.trim("event_type"))))
    return _counted(Fo.accepted(e, ["user_id", "q"], "us", "event_id", 3_600_000_000), "user_id", "q")


@query("""WITH o AS (SELECT user_id, list({'us': epoch_us(ts), 'bad': event_type = 'error', 'fails': 0, 'since': 0::BIGINT, 'rejected': 0} ORDER BY ts, event_id) AS l FROM (SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 40000) AS ts, CASE WHEN value > 30 THEN 'error' ELSE event_type END AS event_type) FROM events) GROUP BY user_id),
 f AS (SELECT user_id, list_reduce(l, lambda s, x: {'us': x.us, 'bad': x.bad,
  'fails': CASE WHEN s.fails >= 5 AND x.us - s.since <= 30000000 THEN s.fails WHEN x.bad THEN CASE WHEN s.fails >= 5 THEN 1 ELSE s.fails + 1 END ELSE 0 END,
  'since': CASE WHEN NOT (s.fails >= 5 AND x.us - s.since <= 30000000) AND x.bad THEN x.us ELSE s.since END, 'rejected': s.rejected + (s.fails >= 5 AND x.us - s.since <= 30000000)::INT}, {'us': 0::BIGINT, 'bad': false, 'fails': 0, 'since': 0::BIGINT, 'rejected': 0}) AS s FROM o) SELECT user_id, s.fails::INT AS fails, s.rejected::INT AS rejected FROM f""")
def sm_breaker(spark: SparkSession, d: str) -> DataFrame:
    """A breaker for each user over calls in quick succession, most of which fail: open for 30 seconds after five failures."""
    zero = 1704067200000000
    quick = zero + F.floor((F.col("us") - zero) / 40000)
    e = events(spark, d).select("user_id", "event_id", quick.alias("us"), ((F.col("event_type") == "error") | (F.col("value") > 30)).alias("bad"))

    def step(s: tuple, us: int, bad: bool) -> tuple:
        fails, since, rejected = s
        if fails >= 5 and us - since <= 30_000_000:
            return fails, since, rejected + 1
        if bad:
            return (1 if fails >= 5 else fails + 1), us, rejected
        return 0, since, rejected

    return Fo.fold(e, ["user_id"], ["us", "event_id"], ["us", "bad"], (0, 0, 0), step, lambda s: (s[0], s[2]), "fails int, rejected int")


# Traffic


#: Half minutes over the times of events a thousandth as far apart, so that each has its load.
TRAFFIC_SQL = """
WITH b AS (SELECT ((epoch_us(ts) - 1704067200000000) // 1000 // 30000000)::BIGINT * 30 AS t, count(*) AS rps, least(99, round(20 + avg(value)))::BIGINT AS cpu, least(98, round(30 + max(value) / 8))::BIGINT AS memory FROM events GROUP BY 1),
a AS (SELECT *, avg(rps) OVER () AS usual FROM b), w AS (SELECT *, rps > 1.15 * usual AS high, lag(rps > 1.15 * usual) OVER (ORDER BY t) AS was FROM a),
s AS (SELECT t, rps, cpu, memory, CASE WHEN was AND NOT high THEN 'SPIKE_END' END AS event FROM w)
"""


def traffic(spark: SparkSession, d: str) -> DataFrame:
    """t, rps, cpu, memory, event every half minute: the load of events, and where a spike above 1.15 of the usual load ends."""
    t = F.floor((F.col("us") - 1704067200000000) / 30_000_000_000) * 30
    b = events(spark, d).groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("rps"), F.least(F.lit(99), F.round(20 + F.avg("value"))).cast("long").alias("cpu"), F.least(F.lit(98), F.round(30 + F.max("value") / 8)).cast("long").alias("memory"))
    a = b.crossJoin(F.broadcast(b.agg(F.avg("rps").alias("usual")))).withColumn("high", F.col("rps") > 1.15 * F.col("usual"))  # one row
    was = F.lag("high").over(Window.orderBy("t"))  # a row for each half minute
    return a.select("t", "rps", "cpu", "memory", F.when(was & ~F.col("high"), "SPIKE_END").alias("event"))


@query(TRAFFIC_SQL + "SELECT * FROM s")
def x_traffic_sim(spark: SparkSession, d: str) -> DataFrame:
    return traffic(spark, d)


@query(TRAFFIC_SQL + """, m AS (SELECT max(rps) AS rps, max(cpu) AS cpu, max(memory) AS memory, round(avg(rps))::BIGINT AS mean FROM s)
SELECT 'peak' AS part, NULL AS t, rps, cpu, memory, NULL AS event FROM m UNION ALL SELECT 'mean', NULL, mean, NULL, NULL, NULL FROM m
UNION ALL (SELECT 'timeline', t, rps, cpu, memory, event FROM s WHERE event IS NOT NULL OR rps > 2 * (SELECT mean FROM m) OR cpu > 80 ORDER BY t LIMIT 10)""")
def x_metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Peaks, the mean, and the first ten moments of note of the traffic."""
    s = traffic(spark, d)
    a = s.agg(F.max("rps").alias("rps"), F.max("cpu").alias("cpu"), F.max("memory").alias("memory"), F.round(F.avg("rps")).cast("long").alias("mean"))
    no = lambda kind: F.lit(None).cast(kind)
    peak = a.select(F.lit("peak").alias("part"), no("long").alias("t"), "rps", "cpu", "memory", no("string").alias("event"))
    mean = a.select(F.lit("mean").alias("part"), no("long").alias("t"), F.col("mean").alias("rps"), no("long").alias("cpu"), no("long").alias("memory"), no("string").alias("event"))
    line = s.crossJoin(F.broadcast(a.select("mean"))).where("event IS NOT NULL OR rps > 2 * mean OR cpu > 80").orderBy("t").limit(10)  # one row is broadcast
    return peak.unionByName(mean).unionByName(line.select(F.lit("timeline").alias("part"), "t", "rps", "cpu", "memory", "event"))


@query("""WITH t AS (SELECT user_id, event_type AS topic, count(*) AS n, sum((value > 50)::INT) AS c FROM events GROUP BY ALL), p AS (SELECT user_id, sum(n)::BIGINT AS asked, sum(c)::BIGINT AS correct,
 array_to_string(list(topic ORDER BY round(c / n::DOUBLE, 3) DESC, topic)[1:5], ',') AS strengths, coalesce(array_to_string((list(topic ORDER BY c, topic) FILTER (c < 8))[1:3], ','), '') AS weak FROM t GROUP BY user_id) SELECT user_id, asked, correct, round(100.0 * correct / asked)::INT AS accuracy, strengths, weak FROM p""")
def x_profile_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals, accuracy in percent, the five best topics and the three weakest of those still weak."""
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("c"))
    listed = lambda by, k, when: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(by.alias("a"), "event_type")))), lambda x: x["event_type"]), 1, k), ",")
    p = t.groupBy("user_id").agg(F.sum("n").alias("asked"), F.sum("c").alias("correct"), listed(-F.round(F.col("c") / F.col("n"), 3), 5, F.lit(True)).alias("strengths"), listed(F.col("c"), 3, F.col("c") < 8).alias("weak"))
    return p.select("user_id", "asked", "correct", F.round(100.0 * F.col("correct") / F.col("asked")).cast("int").alias("accuracy"), "strengths", "weak")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, 6 - substr(o_orderpriority, 1, 1)::INT AS priority, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 4 END AS hours FROM orders),
 b AS (SELECT *, coalesce(sum(hours) OVER (PARTITION BY o_custkey ORDER BY priority DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
 SELECT o_custkey, day::INT AS day, o_orderkey, least(hours, 4 - before)::INT AS hours FROM b, range(7) r(day) WHERE before < 4 AND (o_custkey + day) % 5 <> 0""")
def g_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's week: on every day that is not blocked, subjects by priority until four hours are full."""
    k = F.col("o_orderkey") % 4
    s = table(spark, d, "orders").select("o_custkey", "o_orderkey", (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.when(k == 0, 1).otherwise(k).alias("hours"))
    before = Window.partitionBy("o_custkey").orderBy(F.desc("priority"), "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("before", F.coalesce(F.sum("hours").over(before), F.lit(0))).where("before < 4")
    days = s.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(6)))).where((F.col("o_custkey") + F.col("day")) % 5 != 0)
    return days.select("o_custkey", "day", "o_orderkey", F.least(F.col("hours"), 4 - F.col("before")).cast("int").alias("hours"))
