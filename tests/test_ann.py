"""The proximity graph index: recall and vectors met, equal vectors, several parts, hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import ann
from tessella.operators.tables import written
from tessella.plans import q_retrieval


def exact(vectors, queries, k=10):
    sims = ann.unit(queries) @ ann.unit(vectors).T
    return [set(np.argsort(-row, kind="stable")[:k].tolist()) for row in sims]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_query(spark, size):
    sf = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    vectors = np.array([r.embedding for r in rows], float)
    own = [i for i, r in enumerate(rows) if r.vec_id % 20 == 0]
    want = {(rows[i].vec_id, rows[j].vec_id) for i, near in zip(own, exact(vectors, vectors[own]), strict=True) for j in near}
    found = q_retrieval.ret_hnsw(spark, sf).collect()
    assert len(found) == 10 * len(own) and {r["rank"] for r in found} == set(range(1, 11))
    assert len(want & {(r.query, r.vec_id) for r in found}) >= 0.95 * len(want)


def test_share_of_vectors_met_falls(spark):
    """From 2,000 to 20,000 vectors recall stays and the share of vectors that a query meets falls to less than a third."""
    base = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], float)
    rng = np.random.default_rng(4)
    i, j = rng.integers(0, len(base), (2, 20_000))
    a = rng.random((20_000, 1))
    shares = []
    for vectors in (base, a * base[i] + (1 - a) * base[j] + 0.05 * rng.standard_normal((20_000, base.shape[1]))):
        df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
        index = written(ann.build(df, "vec_id", "embedding"))
        own = list(range(0, len(vectors), len(vectors) // 100))
        queries = df.where(F.col("vec_id").isin(own)).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
        found = ann.hits(index, queries, "query", 10).collect()
        want = {(n, m) for n, near in zip(own, exact(vectors, vectors[own]), strict=True) for m in near}
        assert len(want & {(r.query, r.key) for r in found}) >= 0.95 * len(want)
        shares.append(np.mean([m for _, m in {(r.query, r.met) for r in found}]) / len(vectors))
    print("shares met", shares)
    assert shares[0] < 0.5 and shares[1] < shares[0] / 3


def test_equal_vectors_are_one_node_and_lose_no_key(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 8))
    rows = [(n, v.tolist()) for n, v in enumerate(vectors)] + [(1000 + n, vectors[7].tolist()) for n in range(150)] + [(2000, vectors[9].tolist())] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build(df, "vec_id", "embedding", part_rows=100).persist()
    assert index.count() == 5
    nodes = [keys for r in index.collect() for keys in r.keys]
    assert len(nodes) == 300 and max(map(len, nodes)) == ann.COPIES
    queries = spark.createDataFrame([(1, vectors[7].tolist()), (2, vectors[9].tolist())], "query long, q array<double>")
    found = [(r.query, r.key) for r in ann.search(index, queries, "query", 20).orderBy("query", "rank").collect()]
    assert found[:20] == [(1, 7), *((1, 1000 + n) for n in range(19))]
    assert found[20:23] == [(2, 9), (2, 2000), (2, 2000)]
    assert len(found) == 40
    with pytest.raises(ValueError, match="at most"):
        ann.search(index, queries, "query", ann.COPIES + 1)


def test_queries_are_taken_in_blocks(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    index = ann.build(e, "vec_id", "embedding").persist()
    found = lambda: sorted((r.query, r["rank"], r.key) for r in ann.search(index, q, "query", 3).collect())
    whole = found()
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    monkeypatch.setattr(ann, "WALK_BLOCK", 3)
    assert found() == whole and len(whole) == 75


def test_hard_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit(9)).withColumn("keys", F.lit("x"))
    queries = spark.createDataFrame([("a", [1.0, 0.1]), ("b", None), ("z", [0.0, 0.0])], "query string, q array<double>")
    found = ann.search(ann.build(df, "vec_id", "embedding"), queries, "query", 5).collect()
    assert [r.key for r in sorted(found, key=lambda r: r["rank"]) if r.query == "a"] == [2, 1, 4]
    assert {r.query for r in found} == {"a", "z"} and {r.score for r in found if r.query == "z"} == {0.0}
    assert ann.search(ann.build(df.limit(0), "vec_id", "embedding"), queries, "query").count() == 0
    assert ann.search(ann.build(df, "vec_id", "embedding"), queries.limit(0), "query").count() == 0


def test_links_join_near_vectors():
    rng = np.random.default_rng(2)
    vectors = ann.unit(rng.standard_normal((200, 6))).astype(np.float32)
    links = ann.links_of(vectors, m=4, most=20)
    assert links.shape == (200, 8)
    nearest = np.argsort(-(vectors @ vectors.T), axis=1)[:, 1]
    assert all(nearest[i] in links[i] for i in range(200))
    assert all(len(set(x[x >= 0])) == (x >= 0).sum() and i not in x for i, x in enumerate(links))
    assert (ann.links_of(vectors[:1]) == -1).all() and set(ann.links_of(vectors[:2]).ravel()) == {-1, 0, 1}
