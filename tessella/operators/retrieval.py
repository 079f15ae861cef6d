"""Retrieval: vector search, BM25, rank fusion and cached answers.

A query set is joined to the corpus by terms (BM25) or compared with it block by block (vectors); what
is broadcast is the query set, whose size is checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import cosine, tokens_bm25
from tessella.operators.tables import spread, written

#: Queries, or terms of queries, of one broadcast.
QUERY_BLOCK = 10_000
#: Entries of a cache that the exact similarity is computed for.
CACHE_CANDIDATES = 16


def nearest(corpus: DataFrame, queries: DataFrame, key: str, vector: str, query: str, k: int, score: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows of each query by cosine (or ``score`` of it), with ``score`` and ``rank``.

    ``queries`` has columns ``query`` and ``q``.  A set larger than ``QUERY_BLOCK`` is taken in blocks
    by the hash of the query, of half that size on average.
    """
    n = queries.count()
    blocks = 1 if n <= QUERY_BLOCK else -(-2 * n // QUERY_BLOCK)

    def best(some: DataFrame) -> DataFrame:
        scored = corpus.crossJoin(F.broadcast(some)).withColumn("score", cosine(F.col(vector), F.col("q")) if score is None else score)
        return top(scored, [query], key, k)

    if blocks == 1:
        return best(queries)
    block = F.pmod(F.xxhash64(query), F.lit(blocks))
    return reduce(DataFrame.unionByName, [best(queries.where(block == i)) for i in range(blocks)])


def checked(examples: DataFrame, most: int = QUERY_BLOCK) -> DataFrame:
    """A set that every row is compared with, broadcast; it is refused if it is larger than ``most``."""
    if examples.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} examples; compare them in blocks, as nearest does")
    return F.broadcast(examples)


def top(scored: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """The ``k`` best rows of each group; ties go to the smaller key."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, dl: the index, to be written once and bucketed by term in a large corpus."""
    t = docs.select(key, tokens_bm25(F.col(text)).alias("ts"))
    return t.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query, key, score of every document that shares a term with a query; repeated query terms count.

    Texts are tokenised once, in one pass that keeps the terms of the queries and one row for each document, by a
    join that is compiled with the rest; what it keeps is written, and read for the frequencies and for the hits.
    """
    terms = queries.select(query, F.explode(tokens_bm25(F.col(query_text))).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qn"))
    terms = written(terms)
    few = terms.count() <= QUERY_BLOCK
    small = F.broadcast if few else lambda df: df  # checked
    own = F.lit("")  # no token is empty: the row of the document itself
    wanted = terms.select("term").distinct().unionByName(queries.sparkSession.range(1).select(own.alias("term")))
    every = spread(docs.select(key, text)).select(F.col(key), F.coalesce(tokens_bm25(F.col(text)), F.array()).alias("ts")).select(key, F.size("ts").alias("dl"), F.explode(F.array_append("ts", own)).alias("term"))
    kept = written(every.join(small(wanted), "term", "left_semi").groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf")))
    n, mean = kept.where("term = ''").agg(F.count(F.lit(1)), F.avg("dl")).first()
    index = kept.where("term <> ''")
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    known = small(terms.join(df, "term"))  # so that a frequent term is no one task's
    part = F.col("qn") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (mean or 1.0)))
    return index.join(known, "term").groupBy(query, key).agg(F.sum(part).alias("score"))


def fuse(lists: list[tuple[DataFrame, float]], by: list[str], key: str, c: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of lists with ``rank`` and ``score``: score, lists, raw best score."""
    parts = [df.select(*by, key, (F.lit(w) / (c + F.col("rank"))).alias("part"), F.col("score").alias("raw")) for df, w in lists]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*by, key).agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("lists"), F.max("raw").alias("raw"))


def blend(a: DataFrame, b: DataFrame, by: list[str], key: str, weight: float) -> DataFrame:
    """Each list's scores over the larger of its best and 1, then ``1 - weight`` to ``weight``."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        most = F.max("score").over(Window.partitionBy(*by))
        return df.select(*by, key, (F.col("score") / F.greatest(most, F.lit(1.0))).alias(name))

    both = scaled(a, "va").join(scaled(b, "vb"), [*by, key], "full")
    return both.select(*by, key, ((1 - weight) * F.coalesce("va", F.lit(0.0)) + weight * F.coalesce("vb", F.lit(0.0))).alias("score"))


def fallback(sources: list[DataFrame]) -> DataFrame:
    """The rows of the first source that has any."""
    tagged = reduce(DataFrame.unionByName, [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)])
    first = tagged.agg(F.min("_source").alias("_first"))
    return tagged.join(F.broadcast(first), F.col("_source") == F.col("_first")).drop("_source", "_first")


def cached_answers(queries: DataFrame, cache: DataFrame, threshold: float = 0.92) -> DataFrame:
    """query, entry, similarity, tier, effective: an entry of equal normalised text, else the nearest one.

    ``queries`` has query, q_text, q; ``cache`` has entry, text, vector, tier_weight.  Nearest entries are looked up in a
    graph index of the cache; the exact cosine ranks the ``CACHE_CANDIDATES`` that it finds and is held against the threshold.
    """
    from tessella.operators import ann

    normal = lambda c: F.regexp_replace(F.trim(F.lower(c)), "\\s+", " ")
    exact = queries.withColumn("_t", normal("q_text")).join(cache.withColumn("_t", normal("text")), "_t").groupBy("query").agg(F.min("entry").alias("entry"))
    exact = exact.select("query", "entry", F.lit(1.0).alias("similarity"), F.lit("exact").alias("tier"), F.lit(1.0).alias("effective"))
    rest = queries.join(exact, "query", "left_anti")
    index = written(ann.build(cache, "entry", "vector"))
    found = ann.search(index, rest.select("query", "q"), "query", CACHE_CANDIDATES).select("query", F.col("key").alias("entry"))
    scored = found.join(cache.select("entry", "vector", "tier_weight"), "entry").join(rest.select("query", "q"), "query").withColumn("score", F.round(cosine(F.col("vector"), F.col("q")), 9))
    near = top(scored.where(F.col("score") >= threshold), ["query"], "entry", 1)
    near = near.select("query", "entry", F.col("score").alias("similarity"), F.lit("semantic").alias("tier"), (F.col("score") * (0.7 + 0.3 * F.col("tier_weight"))).alias("effective"))
    return exact.unionByName(near)
