"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import ann, bm25
from tessella.operators import retrieval as R
from tessella.operators.tables import written
from tessella.plans.registry import query
from tessella.sources.tables import HIERARCHY_SQL, events, hierarchy_edges, table

Q1 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)"
VEC_SQL = f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {Q1}), 9) AS score FROM embeddings"
VEC_LIST = f"(SELECT vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM ({VEC_SQL}) ORDER BY rank LIMIT 50)"
BM25_SQL = """
tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1)) AS term FROM documents),
qt AS (SELECT item_id, term, count(*) AS qn FROM (SELECT item_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1)) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id, count(term) AS dl FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT item_id, doc_id, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)
"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Rows by their cosine to vector 1."""
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("q")))
    return e.crossJoin(q).select("vec_id", "label", F.round(S.cosine(F.col("embedding"), F.col("q")), 9).alias("score"))


def _list(df: DataFrame, key: str, k: int) -> DataFrame:
    """The best k rows as (id, score, rank); the window sees only what the limit left."""
    best = df.orderBy(F.desc("score"), key).limit(k)
    return best.select(F.col(key).alias("id"), "score", F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("qt")), "doc_id", "text", "item_id", "qt")


@query(f"SELECT vec_id, round(CASE WHEN score > 0 THEN score * pow(2.0, -(vec_id % 90) / 30.0) ELSE score END, 6) AS score FROM ({VEC_SQL}) WHERE label IN (0, 1, 2, 3, 4) ORDER BY score DESC, vec_id LIMIT 10")
def ret_vector(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).where(F.col("label").isin(0, 1, 2, 3, 4))
    return v.select("vec_id", F.round(S.half_life(F.col("score"), (F.col("vec_id") % 90).cast("double")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"SELECT label, vec_id, round(w, 6) AS score FROM (SELECT label, vec_id, score * CASE label WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.9 END * CASE WHEN vec_id % 10 = 0 THEN 1.2 ELSE 1 END AS w, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM ({VEC_SQL})) WHERE r <= 5 AND w > 0.1")
def ret_spaces(spark: SparkSession, d: str) -> DataFrame:
    best = R.top(_vectors(spark, d), ["label"], "vec_id", 5)
    w = F.col("score") * F.when(F.col("label") == 0, 1.0).when(F.col("label") == 1, 0.8).otherwise(0.9) * F.when(F.col("vec_id") % 10 == 0, 1.2).otherwise(1.0)
    return best.withColumn("w", w).where("w > 0.1").select("label", "vec_id", F.round("w", 6).alias("score"))


@query(f"SELECT c AS collection, vec_id, round(score, 6) AS score FROM (SELECT label % 3 AS c, vec_id, score, row_number() OVER (PARTITION BY label % 3 ORDER BY score DESC, vec_id) AS r FROM ({VEC_SQL})) WHERE r <= 4")
def ret_collections(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).withColumn("collection", F.col("label") % 3)
    return R.top(v, ["collection"], "vec_id", 4).select("collection", "vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(1 - (1 - score), 6) AS score FROM ({VEC_SQL}) ORDER BY score DESC, vec_id LIMIT 15")
def ret_wh(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).orderBy(F.desc("score"), "vec_id").limit(15).select("vec_id", F.round("score", 6).alias("score"))


@query()
def ret_hnsw(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    index = written(ann.build(e, "vec_id", "embedding"))
    return ann.search(index, q, "query").select("query", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM bm) WHERE r <= 10")
def ret_bm25(spark: SparkSession, d: str) -> DataFrame:
    b = _bm25(spark, d).withColumn("score", F.round("score", 6))
    return R.top(b, ["item_id"], "doc_id", 10).select("item_id", "doc_id", "score")


@query(f"""WITH {BM25_SQL.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 3)", 1).replace("FROM documents d", "FROM (SELECT * FROM documents WHERE doc_id % 10 <> 3) d")}
 SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM bm) WHERE r <= 10""")
def ret_bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stored index of half of the documents, to which the others are added and a tenth is removed."""
    docs = table(spark, d, "documents")
    half = bm25.build(docs.where("doc_id % 2 = 0"), "doc_id", "text")
    index = bm25.remove(bm25.add(half, docs.where("doc_id % 2 = 1"), "doc_id", "text"), docs.where("doc_id % 10 = 3"), "doc_id")
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("qt"))
    return bm25.search(index, asked, "item_id", "qt", 10, 6).select("item_id", F.col("doc").alias("doc_id"), "score")


@query(f"WITH {BM25_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def ret_bm25_index(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


KEYWORD = f"(SELECT doc_id AS id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm WHERE item_id = 0 ORDER BY rank LIMIT 50)"


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The vector list and the keyword list of one question; equal numbers stand for one document."""
    one = table(spark, d, "benchmark").where("item_id = 0").select("item_id", F.col("text").alias("qt"))
    words = R.bm25(table(spark, d, "documents"), one, "doc_id", "text", "item_id", "qt").withColumn("score", F.round("score", 9))
    return _list(_vectors(spark, d), "vec_id", 50), _list(words, "doc_id", 50)


@query(f"WITH {BM25_SQL}, l AS (SELECT * FROM {VEC_LIST} UNION ALL SELECT * FROM {KEYWORD}) SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM l GROUP BY id ORDER BY round(sum(1.0 / (60 + rank)), 6) DESC, id LIMIT 10")
def ret_rrf(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lists(spark, d)
    return R.fuse([(a, 1.0), (b, 1.0)], [], "id").select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"WITH {BM25_SQL}, l AS (SELECT *, 0.7 AS w FROM {VEC_LIST} UNION ALL SELECT *, 0.3 FROM {KEYWORD}) SELECT id, round(sum(w / (60 + rank)), 6) AS score, round(max(score), 6) AS raw FROM l GROUP BY id")
def ret_wrrf(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lists(spark, d)
    return R.fuse([(a, 0.7), (b, 0.3)], [], "id").select("id", F.round("score", 6).alias("score"), F.round("raw", 6).alias("raw"))


@query(f"WITH {BM25_SQL}, l AS (SELECT * FROM {VEC_LIST} UNION ALL SELECT * FROM {KEYWORD}) SELECT id, round(sum(1.0 / (60 + rank)) * CASE WHEN count(*) > 1 THEN 1.3 ELSE 1 END, 6) AS score FROM l GROUP BY id")
def ret_rrf_boost(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lists(spark, d)
    return R.fuse([(a, 1.0), (b, 1.0)], [], "id").select("id", F.round(F.col("score") * F.when(F.col("lists") > 1, 1.3).otherwise(1.0), 6).alias("score"))


@query(f"WITH {BM25_SQL}, a AS {VEC_LIST}, b AS {KEYWORD} SELECT coalesce(a.id, b.id) AS id, round(0.7 * coalesce(a.score / greatest((SELECT max(score) FROM a), 1), 0) + 0.3 * coalesce(b.score / greatest((SELECT max(score) FROM b), 1), 0), 6) AS score FROM a FULL JOIN b ON a.id = b.id")
def ret_minmax_fuse(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.withColumn("one", F.lit(0)) for x in _lists(spark, d))
    return R.blend(a, b, ["one"], "id", 0.3).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25_SQL}, l AS (SELECT *, 0.5 AS w FROM {VEC_LIST} UNION ALL SELECT *, 0.5 FROM {KEYWORD}) SELECT id, round(sum(w / (60 + rank)), 6) AS score, count(*) AS lists FROM l GROUP BY id ORDER BY 2 DESC, id LIMIT 20")
def ret_hybrid(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lists(spark, d)  # where one list is empty the other alone remains
    return R.fuse([(a, 0.5), (b, 0.5)], [], "id").select("id", F.round("score", 6).alias("score"), "lists").orderBy(F.desc("score"), "id").limit(20)


@query("SELECT vec_id, label, intent, round(s, 6) AS score FROM (SELECT e.vec_id, e.label, arg_max(q.label, (round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), -q.vec_id)) AS intent, max(round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) q GROUP BY ALL)")
def ret_intent(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = R.checked(e.groupBy(F.col("label").alias("intent")).agg(F.min_by("embedding", "vec_id").alias("q"), F.min("vec_id").alias("x")))  # an example for each intent
    s = e.crossJoin(q).withColumn("s", F.round(S.cosine(F.col("embedding"), F.col("q")), 9))
    return s.groupBy("vec_id", "label").agg(F.max_by("intent", F.struct("s", -F.col("x"))).alias("intent"), F.round(F.max("s"), 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'Apache')")
def ret_fallback3(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return R.fallback([docs.where("text = 'no such text'").select("doc_id"), docs.where(F.col("text").contains("Apache")).select("doc_id"), docs.orderBy(F.xxhash64("doc_id")).limit(5).select("doc_id")])
