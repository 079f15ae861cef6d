"""Queries of the scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions import words as W
from tessella.operators.folds import fold
from tessella.plans import _sql as Q
from tessella.plans.registry import query
from tessella.sources.tables import events, table

DAYS = "date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 86400000000.0"


def _days() -> F.Column:
    """Days from an event to the fixed as-of time."""
    return (F.lit(1706745600000000) - F.col("us")) / F.lit(86400000000.0)


@query("SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1))::INT AS n_tokens FROM documents")
def sc_tokenize_bm25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(S.tokens_bm25(F.col("text"))).alias("n_tokens"))


@query("SELECT conv_id, turn, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))::INT AS n_tokens FROM conversations")
def sc_tokenize_ws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(S.tokens_ws(F.col("text"))).alias("n_tokens"))


F1_SQL = """
WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(d.text), '\\s+'), lambda w: w <> '')) AS a, item_id, list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda w: w <> '')) AS t
  FROM documents d JOIN benchmark b ON doc_id % (SELECT count(*) FROM benchmark) = item_id),
p AS (SELECT doc_id, item_id, len(list_intersect(a, t))::DOUBLE AS i, len(a) AS n, len(t) AS m FROM w),
f AS (SELECT doc_id, item_id, CASE WHEN n > 0 THEN i / n ELSE 0 END AS p, CASE WHEN m > 0 THEN i / m ELSE 0 END AS r FROM p)
"""


def _answered(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an answer, with an item of the benchmark as the truth in turn."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("truth"))
    return table(spark, d, "documents").join(b, F.col("doc_id") % F.lit(b.count()) == F.col("item_id")).withColumn("s", S.token_f1(F.col("text"), F.col("truth")))


@query(F1_SQL + "SELECT doc_id, item_id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM f")
def sc_f1(spark: SparkSession, d: str) -> DataFrame:
    return _answered(spark, d).select("doc_id", "item_id", F.round("s.precision", 6).alias("p"), F.round("s.recall", 6).alias("r"), F.round("s.f1", 6).alias("f1"))


@query(F1_SQL + "SELECT item_id, round(avg(round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4)), 6) AS mean_f1, count(*) AS n FROM f GROUP BY item_id")
def agg_f1_batch(spark: SparkSession, d: str) -> DataFrame:
    f = _answered(spark, d).select("item_id", F.round("s.f1", 4).alias("f1"))
    return f.groupBy("item_id").agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, (i - 1)::INT AS chunk_index, length(substr(text, (i - 1) * 900 + 1, 1000))::INT AS n, md5(substr(text, (i - 1) * 900 + 1, 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(1, (greatest(length(text), 1) - 1) // 900 + 2)) AS i FROM documents)")
def sc_chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", F.posexplode(S.chunk_fixed(F.col("text"))).alias("chunk_index", "c"))
    return c.select("doc_id", "chunk_index", F.length("c").alias("n"), F.md5("c").alias("digest"))


@query("""WITH p AS (SELECT doc_id, text, pos, substr(text, pos + 1, 600) AS piece FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, greatest(length(coalesce(text, '')), 1), 480)) AS pos FROM documents)),
 w AS (SELECT *, list_max(list_transform(range(0, length(piece)), lambda i: CASE WHEN substr(piece, i + 1, 1) = chr(10) THEN i ELSE -1 END)) AS line, list_max(list_transform(range(0, length(piece)), lambda i: CASE WHEN substr(piece, i + 1, 2) = '. ' THEN i + 1 ELSE 0 END)) AS stop FROM p),
 c AS (SELECT doc_id, pos, regexp_replace(CASE WHEN pos + 600 < length(text) AND greatest(line, stop) > 300 THEN substr(piece, 1, greatest(line, stop)) ELSE piece END, '^\\s+|\\s+$', '', 'g') AS chunk FROM w)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS chunk_index, length(chunk)::INT AS n, md5(chunk) AS digest FROM c WHERE chunk <> ''""")
def sc_chunk_sent(spark: SparkSession, d: str) -> DataFrame:
    from tessella.operators.chunking import chunk_sentences

    return chunk_sentences(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


@query()
def sc_embed_local(spark: SparkSession, d: str) -> DataFrame:
    from tessella.operators.embedding import embed_local

    e = table(spark, d, "benchmark").select("item_id", embed_local(F.col("text")).alias("v"))
    return e.select("item_id", F.size("v").alias("dim"), F.round(S.norm(F.col("v")), 4).alias("norm"))


PAIR_SQL = "FROM embeddings e CROSS JOIN (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.crossJoin(F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("q"))))


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS sim {PAIR_SQL}")
def sc_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS dist {PAIR_SQL}")
def sc_cosdist(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", F.round(F.when(S.norm(F.col("embedding")) > 0, 1 - S.cosine(F.col("embedding"), F.col("q"))).otherwise(2.0), 6).alias("dist"))


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], q), 6) AS dist {PAIR_SQL}")
def sc_l2(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", F.round(S.euclidean(F.col("embedding"), F.col("q")), 6).alias("dist"))


@query(f"SELECT event_id, round(CASE WHEN value > 0 THEN value * pow(2.0, -({DAYS}) / 30) ELSE value END, 6) AS score FROM events")
def sc_decay_half(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.round(S.half_life(F.col("value"), _days()), 6).alias("score"))


@query(f"SELECT event_id, round(greatest(0.1, round(0.9 * exp(-({DAYS}) * ln(2) / 14), 4)), 4) AS affinity, round(exp(-({DAYS}) * ln(2) / 3), 6) AS mood FROM events")
def sc_ebbinghaus(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", S.decayed(F.lit(0.9), _days(), "category_affinity").alias("affinity"), F.round(S.retention(_days(), 3), 6).alias("mood"))


@query(f"SELECT event_id, round(greatest(0.1, least(1.0, 0.5 + (0.9 - 0.5) * pow(0.95, {DAYS}))), 6) AS trust FROM events")
def sc_trust_decay(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.round(S.trust_decay(F.lit(0.9), _days()), 6).alias("trust"))


@query("""
WITH o AS (SELECT user_id, list(event_type = 'purchase' ORDER BY ts) AS ok FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT user_id, len(ok)::INT AS n, round(list_reduce(list_transform(ok, lambda x: CASE WHEN x THEN 1.0::DOUBLE ELSE -1.0 END), lambda s, x: CASE WHEN x > 0 THEN least(1.0, s + 0.05) ELSE greatest(0.1, s - 0.15) END, 0.5::DOUBLE), 6) AS trust FROM o""")
def sc_trust_update(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where(F.col("event_type").isin("purchase", "error")).withColumn("ok", F.col("event_type") == "purchase")
    trust = fold(e, ["user_id"], ["us", "event_id"], ["ok"], (0, 0.5), lambda s, ok: (s[0] + 1, S.trust_step(s[1], ok)), tuple, "n int, trust double")
    return trust.withColumn("trust", F.round("trust", 6))


@query("""
WITH c AS (SELECT event_id, 1 + (event_id % 7) AS s, 1 + (event_id % 9) AS d, [1, 3, 4][event_id % 3 + 1] AS r, (event_id % 11)::DOUBLE AS e FROM events),
x AS (SELECT *, s * (1 + 1.49 * pow(d, -0.14) * pow(s, 0.4) * (exp((1 - exp(ln(0.9) * e / s)) * 0.6) - 1)) AS grown FROM c),
y AS (SELECT event_id, CASE r WHEN 1 THEN 0.94 * pow(s, -0.05) * (exp(0.1 * 0.34) - 1) WHEN 3 THEN grown ELSE grown * 2.4 END AS ns,
  CASE r WHEN 1 THEN d + 2.18 * (1 - d / 10) WHEN 3 THEN d - 2.18 * (d / 10 - 0.5) ELSE d - 2.18 * d / 10 END AS nd FROM x)
SELECT event_id, round(greatest(0.1, least(3650.0, ns)), 6) AS stability, round(greatest(1.0, least(10.0, nd)), 6) AS difficulty FROM y""")
def sc_fsrs(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    f = S.fsrs((1 + e % 7).cast("double"), (1 + e % 9).cast("double"), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (e % 3 + 1).cast("int")), (e % 11).cast("double"))
    return table(spark, d, "events").select("event_id", f.alias("f")).select("event_id", F.round("f.stability", 6).alias("stability"), F.round("f.difficulty", 6).alias("difficulty"))


@query(f"SELECT event_id, CASE WHEN e < 0 THEN 'learning' WHEN r > 0.9 THEN 'mastered' WHEN r > 0.7 THEN 'review' ELSE 'lapsed' END AS status, round(r, 6) AS retrievability FROM (SELECT event_id, {DAYS} AS e, exp(ln(0.9) * greatest(0.0, {DAYS}) / (1 + event_id % 30)) AS r FROM events)")
def sc_card_status(spark: SparkSession, d: str) -> DataFrame:
    s = (1 + F.col("event_id") % 30).cast("double")
    return events(spark, d).select("event_id", S.card_status(_days(), s).alias("status"), F.round(F.exp(F.log(F.lit(0.9)) * F.greatest(F.lit(0.0), _days()) / s), 6).alias("retrievability"))


_REP = "CASE domain " + " ".join(f"WHEN {Q.text(h)} THEN {v}" for h, v in W.REPUTATION) + " ELSE 0.5 END"
QUALITY_SQL = f"""
WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') AS domain, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t, page_id % 500 AS points, page_id % 3 * 400 AS stars FROM pages),
s AS (SELECT page_id, 0.25 + 0.5 * ({_REP}) + CASE WHEN points > 0 THEN 0.15 * least(1.0, log10(points + 1) / 3.5) ELSE 0 END + CASE WHEN stars > 0 THEN 0.15 * least(1.0, log10(stars + 1) / 4) ELSE 0 END
  + 0.03 * {Q.count_of("t", W.QUALITY_POSITIVE)} - 0.15 * {Q.count_of("t", W.QUALITY_NEGATIVE)} + CASE WHEN length(t) < 15 THEN -0.1 WHEN length(t) > 40 THEN 0.03 ELSE 0 END AS s FROM p),
q AS (SELECT page_id, round(greatest(0.0, least(1.0, s)), 6) AS score FROM s)
"""


def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    domain = F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), "^www\\.", "")
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    p = table(spark, d, "pages").select("page_id", domain.alias("domain"), title.alias("t"), (F.col("page_id") % 500).alias("points"), (F.col("page_id") % 3 * 400).alias("stars"))
    rep = F.lit(0.5)
    for host, v in W.REPUTATION:
        rep = F.when(F.col("domain") == host, v).otherwise(rep)
    grown = lambda c, by: F.when(F.col(c) > 0, 0.15 * F.least(F.lit(1.0), F.log10(F.col(c) + 1) / by)).otherwise(0.0)
    n = F.length("t")
    s = 0.25 + 0.5 * rep + grown("points", 3.5) + grown("stars", 4.0) + 0.03 * S.count_of(F.col("t"), W.QUALITY_POSITIVE) - 0.15 * S.count_of(F.col("t"), W.QUALITY_NEGATIVE) + F.when(n < 15, -0.1).when(n > 40, 0.03).otherwise(0.0)
    return p.select("page_id", F.round(S.clamp(s, 0.0, 1.0), 6).alias("score"))


@query(QUALITY_SQL + "SELECT page_id, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM q")
def sc_quality(spark: SparkSession, d: str) -> DataFrame:
    q = quality_scores(spark, d)
    return q.withColumn("level", F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.5, "medium").otherwise("low"))


@query(QUALITY_SQL + "SELECT page_id, score FROM q WHERE score >= 0.35")
def filt_min_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality_scores(spark, d).where("score >= 0.35")


_KINDS = ["repo", "video", "reddit", "stackoverflow", "hackernews", "arxiv", "other"]


@query(f"""
WITH e AS (SELECT event_id, {_KINDS}[event_id % 7 + 1] AS kind, greatest(value, 0) AS a, event_id % 5 <> 0 AS rel, ['high', 'low', 'medium'][event_id % 3 + 1] AS conf FROM events),
s AS (SELECT *, CASE WHEN kind = 'arxiv' THEN 0.75 WHEN kind = 'other' OR a <= 0 THEN 0.6 ELSE least(1.0, log10(a + 1) / CASE kind WHEN 'repo' THEN 5.0 WHEN 'video' THEN 6.0 WHEN 'stackoverflow' THEN 2.5 ELSE 3.0 END) END AS s FROM e)
SELECT event_id, kind, round(greatest(0.0, least(1.0, s * CASE WHEN NOT rel THEN 0.5 ELSE 1.0 END * CASE conf WHEN 'high' THEN 1.1 WHEN 'low' THEN 0.85 ELSE 1.0 END)), 6) AS score FROM s""")
def sc_source_score(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (e % 7 + 1).cast("int"))
    conf = F.element_at(F.array(*map(F.lit, ["high", "low", "medium"])), (e % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", kind.alias("kind"), F.round(S.source_score(kind, F.greatest(F.col("value"), F.lit(0.0)), e % 5 != 0, conf), 6).alias("score"))


@query("SELECT event_id, round(least(1.0, (log10(event_id + 1) * 10 + log10(value + 1) * 5) / 100), 6) AS video, round(least(1.0, (log10(event_id + 1) * 15 + log10(value + 1) * 8) / 100), 6) AS repo FROM events")
def sc_yt_gh_score(spark: SparkSession, d: str) -> DataFrame:
    v, n = F.log10(F.col("event_id") + 1), F.log10(F.col("value") + 1)
    return table(spark, d, "events").select("event_id", F.round(F.least(F.lit(1.0), (v * 10 + n * 5) / 100), 6).alias("video"), F.round(F.least(F.lit(1.0), (v * 15 + n * 8) / 100), 6).alias("repo"))


@query(f"""SELECT conv_id, turn, round(greatest(0.0, least(1.0, 0.5 + 0.2 * (turn % 10) / 10.0 + CASE WHEN length(text) < 50 THEN -0.15 WHEN length(text) > 200 THEN 0.05 ELSE 0 END
 + CASE WHEN regexp_matches(lower(text), {Q.text(W.CITATION)}) THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(lower(text), {Q.text(W.UNCERTAIN)}) THEN 0.3 ELSE 0 END + (0.8 - 0.5) * 0.3)), 6) AS score FROM conversations""")
def sc_confidence(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.lower("text"), F.length("text")
    s = 0.5 + 0.2 * (F.col("turn") % 10) / 10.0 + F.when(n < 50, -0.15).when(n > 200, 0.05).otherwise(0.0) + F.when(t.rlike(W.CITATION), 0.1).otherwise(0.0) - F.when(t.rlike(W.UNCERTAIN), 0.3).otherwise(0.0) + (0.8 - 0.5) * 0.3
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(S.clamp(s, 0.0, 1.0), 6).alias("score"))


EVAL_SQL = f"""
WITH t AS (SELECT conv_id, turn, text AS query, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response FROM conversations),
k AS (SELECT conv_id, turn, query, lower(response) AS r, list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) > 3) AS ws FROM t WHERE response IS NOT NULL),
s AS (SELECT conv_id, turn, query, 0.15 * least(length(r) / 200.0, 1.0) + 0.35 * CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: contains(r, w)))::DOUBLE / len(ws) ELSE 0.5 END
 + 0.25 * CASE WHEN regexp_matches(r, {Q.text(W.HAS_SOURCE)}) THEN 1.0 ELSE 0.3 END + 0.25 * CASE WHEN regexp_matches(r, {Q.text(W.REFUSAL)}) THEN 0.1 ELSE 1.0 END AS score FROM k)
"""


def evaluations(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, query, score of every turn that has an answer."""
    from pyspark.sql import Window

    t = table(spark, d, "conversations").withColumn("r", F.lower(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))).where("r IS NOT NULL")
    ws = F.filter(F.split(F.lower("text"), "\\s+"), lambda w: F.length(w) > 3)
    hits = F.size(F.filter(ws, lambda w: F.col("r").contains(w))).cast("double")
    score = 0.15 * F.least(F.length("r") / 200.0, F.lit(1.0)) + 0.35 * F.when(F.size(ws) > 0, hits / F.size(ws)).otherwise(0.5)
    score = score + 0.25 * F.when(F.col("r").rlike(W.HAS_SOURCE), 1.0).otherwise(0.3) + 0.25 * F.when(F.col("r").rlike(W.REFUSAL), 0.1).otherwise(1.0)
    return t.select("conv_id", "turn", F.col("text").alias("query"), score.alias("score"))


@query(EVAL_SQL + "SELECT conv_id, turn, round(score, 6) AS score FROM s")
def sc_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluations(spark, d).select("conv_id", "turn", F.round("score", 6).alias("score"))


@query(EVAL_SQL + "SELECT count(*) AS total, round(avg(score), 6) AS avg_score, sum((score < 0.6)::INT)::BIGINT AS low, round(avg((score < 0.6)::INT), 6) AS low_rate FROM s")
def agg_eval(spark: SparkSession, d: str) -> DataFrame:
    low = (F.col("score") < 0.6).cast("int")
    return evaluations(spark, d).agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("score"), 6).alias("avg_score"), F.sum(low).alias("low"), F.round(F.avg(low), 6).alias("low_rate"))


@query(EVAL_SQL + ", w AS (SELECT unnest(string_split_regex(lower(query), '\\s+')) AS topic FROM s WHERE score < 0.6) SELECT topic, count(*) AS n FROM w WHERE length(topic) > 4 GROUP BY topic ORDER BY n DESC, topic LIMIT 10")
def agg_gap_terms(spark: SparkSession, d: str) -> DataFrame:
    w = evaluations(spark, d).where("score < 0.6").select(F.explode(F.split(F.lower("query"), "\\s+")).alias("topic")).where("length(topic) > 4")
    return w.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(10)


@query("""SELECT doc_id, round(0.5 + 0.15 * s::INT + 0.15 * h::INT + 0.1 * e::INT + 0.05 * c::INT + 0.05 * (n > 100 AND n < 1000)::INT, 6) AS score FROM (SELECT doc_id, regexp_matches(text, '(^|\\n)([#]{1,3}\\s|[0-9]+\\.\\s|\\s*[-*])') AS s,
 regexp_matches(lower(text), 'source|according to|based on|from|http') AS h, regexp_matches(lower(text), 'example|for instance|such as') AS e, contains(text, '`') AS c, len(string_split_regex(text, '\\s+')) AS n FROM documents)""")
def sc_structure(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("text"), F.size(F.split("text", "\\s+"))
    flag = lambda c: c.cast("int")
    s = 0.5 + 0.15 * flag(t.rlike("(^|\\n)([#]{1,3}\\s|[0-9]+\\.\\s|\\s*[-*])")) + 0.15 * flag(F.lower(t).rlike("source|according to|based on|from|http"))
    s = s + 0.1 * flag(F.lower(t).rlike("example|for instance|such as")) + 0.05 * flag(t.contains("`")) + 0.05 * flag((n > 100) & (n < 1000))
    return table(spark, d, "documents").select("doc_id", F.round(s, 6).alias("score"))


@query("""
WITH sent AS (SELECT doc_id, lower(b.text) AS s, unnest(list_filter(string_split_regex(d.text, '[.!?]+'), lambda x: length(trim(x)) > 20)[1:5]) AS x FROM documents d JOIN benchmark b ON doc_id % (SELECT count(*) FROM benchmark) = item_id),
w AS (SELECT doc_id, s, list_filter(string_split_regex(lower(x), '\\s+'), lambda y: length(y) > 3) AS ws FROM sent),
b AS (SELECT doc_id, s, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS bg FROM w WHERE len(ws) >= 3)
SELECT doc_id, count(*) AS sentences, sum((len(list_filter(bg, lambda g: contains(s, g)))::DOUBLE / len(bg) < 0.15)::INT)::BIGINT AS unsupported FROM b GROUP BY doc_id""")
def sc_ground(spark: SparkSession, d: str) -> DataFrame:
    sent = F.slice(F.filter(F.split("text", "[.!?]+"), lambda x: F.length(F.trim(x)) > 20), 1, 5)
    w = _answered(spark, d).select("doc_id", F.lower("truth").alias("s"), F.explode(sent).alias("x")).select("doc_id", "s", F.filter(F.split(F.lower("x"), "\\s+"), lambda y: F.length(y) > 3).alias("ws")).where("size(ws) >= 3")
    b = w.withColumn("bg", F.zip_with(F.slice("ws", 1, F.size("ws") - 1), F.slice("ws", 2, F.size("ws") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    few = (F.size(F.filter("bg", lambda g: F.col("s").contains(g))) / F.size("bg") < 0.15).cast("int")
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(few).alias("unsupported"))


MOOD_SQL = f"""
WITH h AS (SELECT conv_id, turn, conv_id * 7 % 24 AS hour, length(text) AS n, {Q.count_of("lower(text)", W.POSITIVE)} AS p, {Q.count_of("lower(text)", W.NEGATIVE)} AS g, {Q.count_of("lower(text)", W.STRESSED)} AS s, {Q.count_of("lower(text)", W.CELEBRATING)} AS c FROM conversations),
mood AS (SELECT conv_id, turn, CASE WHEN c > 0 THEN 'celebrating' WHEN s >= 2 OR (s > 0 AND g > 0) THEN 'stressed' WHEN hour < 5 AND (g > 0 OR n < 10) THEN 'burnout' WHEN hour < 5 OR hour >= 22 THEN 'tired'
 WHEN p > g AND n > 200 THEN 'curious' WHEN p > 0 OR (n > 200 AND g = 0) THEN 'focused' ELSE 'neutral' END AS state FROM h)
"""


def moods(spark: SparkSession, d: str) -> DataFrame:
    t, hour, n = F.lower("text"), F.col("conv_id") * 7 % 24, F.length("text")
    p, g, s, c = (S.count_of(t, w) for w in (W.POSITIVE, W.NEGATIVE, W.STRESSED, W.CELEBRATING))
    return table(spark, d, "conversations").select("conv_id", "turn", mood_of(p, g, s, c, hour, n).alias("state"))


def mood_of(p, g, s, c, hour, n):
    return (
        F.when(c > 0, "celebrating").when((s >= 2) | ((s > 0) & (g > 0)), "stressed").when((hour < 5) & ((g > 0) | (n < 10)), "burnout").when((hour < 5) | (hour >= 22), "tired")
        .when((p > g) & (n > 200), "curious").when((p > 0) | ((n > 200) & (g == 0)), "focused").otherwise("neutral")
    )


@query(MOOD_SQL + "SELECT * FROM mood")
def sc_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return moods(spark, d)


@query(MOOD_SQL + "SELECT conv_id, state, n FROM (SELECT conv_id, state, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, state) AS r FROM mood GROUP BY conv_id, state) WHERE r = 1")
def agg_dominant(spark: SparkSession, d: str) -> DataFrame:
    n = moods(spark, d).groupBy("conv_id", "state").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("conv_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "state")).alias("b"))
    return best.select("conv_id", "b.state", (-F.col("b.m")).alias("n"))


@query(MOOD_SQL + "SELECT conv_id, turn, prev AS from_state, state AS to_state FROM (SELECT *, lag(state) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM mood) WHERE prev <> state")
def win_transition(spark: SparkSession, d: str) -> DataFrame:
    from tessella.operators.windows import transitions

    return transitions(moods(spark, d), ["conv_id"], "turn", "state").select("conv_id", "turn", F.col("previous").alias("from_state"), F.col("state").alias("to_state"))


@query("SELECT event_id, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN event_type = 'click' THEN 0.3 ELSE 0 END + CASE WHEN value IS NULL THEN -0.15 WHEN value * 2000 < 30000 THEN 0.2 WHEN value * 2000 < 300000 THEN 0.05 ELSE -0.05 END)), 6) AS score FROM events")
def sc_implicit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(S.implicit_signal(F.col("event_type") == "click", F.col("value") * 2000), 6).alias("score"))


@query(f"SELECT conv_id, turn, {Q.case([(f'regexp_matches(lower(text), {Q.text(p)})', n) for n, p in W.INTENTS], Q.text('GENERAL'))} AS intent FROM conversations")
def sc_intent_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", S.first_match([(F.lower("text").rlike(p), n) for n, p in W.INTENTS], "GENERAL").alias("intent"))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(q, {Q.text(W.MODEL_POWERFUL)}) THEN 'powerful' WHEN length(q) < 80 AND regexp_matches(q, {Q.text(W.MODEL_FAST)}) THEN 'fast' WHEN regexp_matches(q, {Q.text(W.MODEL_DEEP)}) THEN 'powerful' WHEN length(q) > 200 THEN 'standard' ELSE 'fast' END AS tier FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations)")
def sc_model_tier(spark: SparkSession, d: str) -> DataFrame:
    q = F.lower("text")
    tier = F.when(q.rlike(W.MODEL_POWERFUL), "powerful").when((F.length(q) < 80) & q.rlike(W.MODEL_FAST), "fast").when(q.rlike(W.MODEL_DEEP), "powerful").when(F.length(q) > 200, "standard").otherwise("fast")
    return table(spark, d, "conversations").select("conv_id", "turn", tier.alias("tier"))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), {Q.text(chr(92) + 'b(' + W.CODE_WORDS + ')' + chr(92) + 'b')}) THEN 0.7::DOUBLE WHEN n <= 3 THEN 0.6 WHEN n > 10 THEN 0.3 ELSE 0.5 END AS weight FROM (SELECT *, len(string_split_regex(trim(text), '\\s+')) AS n FROM conversations)")
def sc_bm25_weight(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.split(F.trim("text"), "\\s+"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.lower("text").rlike(f"\\b({W.CODE_WORDS})\\b"), 0.7).when(n <= 3, 0.6).when(n > 10, 0.3).otherwise(0.5).alias("weight"))


@query(f"SELECT doc_id, array_to_string(list_filter({W.JOB_TAGS}, lambda k: contains(lower(text), k))[1:10], ',') AS tags FROM documents")
def sc_tags(spark: SparkSession, d: str) -> DataFrame:
    hits = F.filter(F.array(*map(F.lit, W.JOB_TAGS)), lambda k: F.lower(F.col("text")).contains(k))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(hits, 1, 10), ",").alias("tags"))


@query("SELECT n_nationkey, substr(sha256('nation:' || lower(trim(n_name))), 1, 16) AS id FROM nation")
def sc_sha_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", S.sha_id(F.lit("nation"), F.col("n_name")).alias("id"))


@query("""SELECT n_nationkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM (SELECT n_nationkey,
 list_reduce(list_transform(string_split(regexp_replace(trim(lower(n_name)), '\\s+', ' ', 'g'), ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296, 0::BIGINT) AS h FROM nation)""")
def sc_hash32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", S.hash32(F.col("n_name")).alias("h"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def sc_json_get(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, '{\"k\":' || (json_extract_string(props, '$.k')::BIGINT + 5) || '}' AS props FROM events")
def sc_json_set(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("props", "map<string,long>")
    return table(spark, d, "events").select("event_id", F.to_json(F.transform_values(m, lambda k, v: F.when(k == "k", v + 5).otherwise(v))).alias("props"))


@query("SELECT event_id, hour(ts)::INT AS h, dayofweek(ts)::INT AS sunday0, ts >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY AS recent FROM events")
def sc_date(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", F.hour(ts).alias("h"), (F.dayofweek(ts) - 1).alias("sunday0"), (ts >= F.expr("timestamp_ntz '2024-01-25 00:00:00'")).alias("recent"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: (0.7 * embedding[i] + 0.3 * q[i]) * (0.7 * embedding[i] + 0.3 * q[i]))), 6) AS energy FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding, q {PAIR_SQL})")
def sc_hyde_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed = F.zip_with("embedding", "q", lambda a, b: 0.7 * a.cast("double") + 0.3 * b.cast("double"))
    return _pairs(spark, d).select("vec_id", F.round(S.dot(mixed, mixed), 6).alias("energy"))


@query("SELECT event_id, round(value / (1 + event_id % 9) + 1.414 * sqrt(ln(100) / (1 + event_id % 9)), 6) AS ucb FROM events")
def sc_ucb1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(S.ucb1(F.col("value"), 1 + F.col("event_id") % 9, F.lit(100.0)), 6).alias("ucb"))
