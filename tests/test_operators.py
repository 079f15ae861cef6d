"""Golden cases and invariants of the operators."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import datalog as D
from tessella.operators import graph as G
from tessella.operators import retrieval as R
from tessella.operators import storage as St
from tessella.operators.chunking import pieces
from tessella.operators.embedding import vector_of
from tessella.plans import q_graph, q_retrieval, q_sources
from tessella.plans.q_scalars import mood_of
from tessella.sources import sinks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def facts(spark, rows, n):
    return spark.createDataFrame(rows, ", ".join(f"a{i} string" for i in range(n)))


def test_datalog_chain(spark):
    found = D.fixpoint({"is_a": facts(spark, [("A", "B"), ("B", "C"), ("C", "D")], 2)}, q_graph.RULES[:1])["is_a"]
    assert {tuple(r) for r in found.collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("b", "d"), ("a", "d")}


def test_datalog_cycle_ends(spark):
    found = D.fixpoint({"is_a": facts(spark, [("a", "b"), ("b", "a")], 2)}, q_graph.RULES[:1])["is_a"]
    assert found.count() == 4


def test_datalog_inherits_and_contradicts(spark):
    k = D.fixpoint({"is_a": facts(spark, [("raft", "consensus"), ("paxos", "consensus")], 2), "deprecated": facts(spark, [("paxos",)], 1), "recommended": facts(spark, [("raft",), ("paxos",)], 1)}, q_graph.RULES)
    assert [tuple(r) for r in D.contradictions(k, "deprecated", "recommended").collect()] == [("paxos",)]


def test_reach_and_depth(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D")], "source string, target string")
    found = {r.node: r.depth for r in G.reach(G.both_ways(e), spark.createDataFrame([("A",)], "node string"), 2).collect()}
    assert found == {"A": 0, "B": 1, "C": 2}


def test_pagerank_keeps_mass(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "source string, target string")
    n = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    ranks = {r.node: r.rank for r in G.pagerank(e, n).collect()}
    assert math.isclose(sum(ranks.values()), 1, abs_tol=1e-6) and ranks["a"] > ranks["e"]


def test_waves_leave_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "source string, target string")
    n = spark.createDataFrame([(x,) for x in "abcxy"], "node string")
    assert {r.node: r.wave for r in G.waves(e, n).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}


def test_bm25_order(spark):
    docs = spark.createDataFrame([("d1", "machine learning with python"), ("d2", "cooking pasta at home"), ("d3", "")], "id string, text string")
    q = spark.createDataFrame([(1, "machine learning"), (2, "absent words")], "q int, qt string")
    assert [r.id for r in R.bm25(docs, q, "id", "text", "q", "qt").collect()] == ["d1"]


def test_fusion(spark):
    a = spark.createDataFrame([("doc1", 0.9, 1), ("doc2", 0.7, 2)], "id string, score double, rank int")
    b = spark.createDataFrame([("doc1", 5.0, 1), ("doc3", 3.0, 2)], "id string, score double, rank int")
    fused = R.fuse([(a, 1.0), (b, 1.0)], [], "id").orderBy(F.desc("score")).collect()
    assert len(fused) == 3 and fused[0].id == "doc1" and math.isclose(fused[0].score, 2 / 61)


@pytest.mark.parametrize("vec, bm, weight, want", [((0.8,), (), 0.3, [0.56]), ((), (5.0,), 0.3, [0.3]), ((0.5,), (10.0,), 0.5, [0.25, 0.5])])
def test_blend(spark, vec, bm, weight, want):
    make = lambda xs, n: spark.createDataFrame([(1, f"{n}{i}", x) for i, x in enumerate(xs)], "one int, id string, score double")
    got = sorted(round(r.score, 6) for r in R.blend(make(vec, "v"), make(bm, "b"), ["one"], "id", weight).collect())
    assert got == want


def test_decay(spark):
    day = lambda v, d, k, m=0.1: value(spark, S.decayed(F.lit(v), F.lit(float(d)), k, m))
    assert day(0.8, 0, "mood_weight") == 0.8
    assert abs(day(1.0, 14, "category_affinity") - 0.5) < 1e-3
    assert day(0.5, 365, "mood_weight", 0.15) == 0.15
    assert abs(day(1.0, 21, "unknown") - 0.5) < 1e-3


@pytest.mark.parametrize("hits, hour, length, want", [((0, 0, 0, 0), 12, 50, "neutral"), ((0, 0, 0, 1), 12, 50, "celebrating"), ((0, 1, 1, 0), 12, 50, "stressed"), ((0, 1, 0, 0), 3, 5, "burnout"), ((0, 0, 0, 0), 23, 50, "tired"), ((2, 0, 0, 0), 12, 300, "curious")])
def test_mood(spark, hits, hour, length, want):
    assert value(spark, mood_of(*map(F.lit, hits), F.lit(hour), F.lit(length))) == want


def test_log_latest_wins(spark):
    log = spark.createDataFrame([("c", "PUT", "3", 1), ("a", "PUT", "1", 2), ("a", "PUT", "new", 3), ("b", "PUT", "2", 4), ("b", "DELETE", None, 5)], "k string, op string, v string, seq int")
    assert {r.k: r.v for r in St.live(log, "k", "seq", "op", "v").collect()} == {"a": "new", "c": "3"}
    assert {r.k for r in St.compact(log, "k", "seq", "op", "v", False).collect()} == {"a", "b", "c"}


def test_nearest_takes_queries_in_blocks(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    found = lambda: sorted((r.query, r.rank, r.vec_id) for r in R.nearest(e, q, "vec_id", "embedding", "query", 3).collect())
    whole = found()
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    assert q.count() > 7 and found() == whole


def test_consolidates_every_document(spark, sf):
    spaces = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        spaces.setdefault({"de": "daily", "es": "daily", "fr": "system"}.get(r.lang, "academic"), []).append(hashlib.md5(r.text.encode()).hexdigest())
    want = {(s, len(h), hashlib.md5("\n".join(h)[:4000].encode()).hexdigest()) for s, h in spaces.items()}
    assert {(r.space, r.n, r.digest) for r in q_sources.sq_consolidate_all(spark, sf).collect()} == want


def test_chunks_cover_the_text():
    text = ". ".join("word" + str(i) for i in range(400))
    assert all(p in text for p in pieces(text)) and "".join(pieces("")) == ""
    assert all(len(p) <= 600 for p in pieces(text))


def test_embedding_is_a_unit_vector():
    assert math.isclose(float((vector_of("Hello") ** 2).sum()), 1, abs_tol=1e-5)
    assert not vector_of("").any()


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_trust_fold_clamps(spark):
    random.seed(2)
    outcomes = [random.random() < 0.7 for _ in range(60)]
    trust = 0.5
    for ok in outcomes:
        trust = min(1.0, trust + 0.05) if ok else max(0.1, trust - 0.15)
    assert math.isclose(value(spark, S.trust_fold(F.array(*map(F.lit, outcomes)))), trust)


def test_chunks_equal_the_rule(spark, sf):
    from tessella.operators.chunking import chunk_sentences

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(90001, ""), (90002, None), (90003, " \n "), (90004, "ab. " * 700 + "\n" + "x" * 2000)], "doc_id long, text string"))
    got = {}
    for r in chunk_sentences(docs, "doc_id", "text").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {r.doc_id: list(pieces(r.text or "")) for r in docs.collect() if list(pieces(r.text or ""))}


def test_embeddings_equal_plain_sums(spark):
    from tessella.operators.embedding import embed_local

    texts = ["", "Hello", "học máy 😀", "x" * 3000, None]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", embed_local(F.col("t")).alias("v")).orderBy("i").collect()]
    for t, v in zip(texts, got, strict=True):
        raw = (t or "").encode("utf-16-le")
        codes = [raw[i] + 256 * raw[i + 1] for i in range(0, len(raw), 2)]
        want = [0.0] * 768
        for i, c in enumerate(codes):
            want[(c * 31 + i * 17) % 768] += c % 100 / 100
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert all(math.isclose(a, b / norm, abs_tol=1e-5) for a, b in zip(v, want, strict=True))


def test_beta_draws_follow_their_law():
    import numpy as np

    from tessella.operators.sequences import gamma_draws

    keys = np.arange(40_000, dtype=np.uint64) * np.uint64(7919)
    x, y = gamma_draws(np.full(len(keys), 4.0), keys), gamma_draws(np.full(len(keys), 9.0), keys, 1000)
    b = x / (x + y)
    assert abs(b.mean() - 4 / 13) < 0.003 and abs(b.var() - 4 * 9 / (13**2 * 14)) < 0.001 and abs(x.mean() - 4) < 0.05


def test_incident_links_of_expanded_nodes(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("a", "a", 4), ("x", "y", 5)], "source string, target string, w int")
    near = G.reach(G.both_ways(edges), spark.createDataFrame([("a",)], "node string"), 2).where("depth < 2")
    assert {tuple(r) for r in G.incident(edges, near).select("source", "target", "w").collect()} == {("a", "b", 1), ("b", "c", 2), ("a", "a", 4)}
    assert G.incident(edges, near).count() == 3
