"""The stored index: same results as scoring everything, blocks skipped, documents added and removed."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import bm25
from tessella.operators import retrieval as R


def whole(docs, asked, k, digits=9):
    scored = R.bm25(docs, asked, "doc_id", "text", "item_id", "qt").withColumn("score", F.round("score", digits))
    return {(r.item_id, r.doc_id, r.score, r["rank"]) for r in R.top(scored, ["item_id"], "doc_id", k).collect()}


def got(index, asked, k, digits=9):
    return {(r.item_id, r.doc, r.score, r["rank"]) for r in bm25.search(index, asked, "item_id", "qt", k, digits).collect()}


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.col("text").alias("qt"))


@pytest.mark.parametrize("k", [1, 10])
def test_search_equals_scoring_everything(tables, k):
    docs, asked = tables
    assert got(bm25.build(docs, "doc_id", "text", segment_docs=20), asked, k, 6) == whole(docs, asked, k, 6)


def skewed(spark):
    """Common words everywhere, rare ones in few documents: what a threshold can skip."""
    word = lambda n, m: F.concat(F.lit("w"), (F.xxhash64("id", F.lit(n)) % m).cast("string"))
    common = F.array_join(F.array(*(F.lit(w) for w in ("the", "of", "and", "to")), *(word(n, 1000) for n in range(30))), " ")
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", common, F.when(F.col("id") % 300 < 12, F.concat(F.lit("rare"), F.floor(F.col("id") / 300)))).alias("text"))
    asked = spark.createDataFrame([(n, f"rare{n} of the and to") for n in range(20)], "item_id long, qt string")
    return docs, asked


def test_blocks_are_skipped_and_results_stay(spark):
    docs, asked = skewed(spark)
    index = bm25.build(docs, "doc_id", "text", segment_docs=50)
    found, read = bm25.searched(index, asked, "item_id", "qt", 10)
    assert {(r.item_id, r.doc, r.score, r["rank"]) for r in found.collect()} == whole(docs, asked, 10)
    a, b = read.agg(F.sum("read"), F.sum("blocks")).first()
    print("blocks read", a, "of", b)
    assert a < 0.3 * b


def test_documents_come_and_go(tables):
    docs, asked = tables
    index = bm25.build(docs.where("doc_id % 3 = 0"), "doc_id", "text", segment_docs=16)
    index = bm25.add(index, docs.where("doc_id % 3 = 1"), "doc_id", "text", segment_docs=16)
    index = bm25.remove(index, docs.where("doc_id % 7 = 1"), "doc_id")
    left = docs.where("doc_id % 3 < 2 AND doc_id % 7 <> 1")
    assert got(index, asked, 5) == whole(left, asked, 5)
    assert index.docs.count() == left.count()
    blocks = index.blocks.agg(F.sum("n"), F.sum(F.size("docs")), F.max("n")).first()
    assert blocks[0] == blocks[1] and blocks[2] <= 60


def test_hard_texts_and_queries(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "alpha Alpha ALPHA beta"), (5, "beta " * 5000), (6, "alpha")], "doc_id long, text string").withColumn("segment", F.lit(1)).withColumn("term", F.lit("x"))
    asked = spark.createDataFrame([(1, "alpha beta beta"), (2, "none at all"), (3, None), (4, "")], "item_id long, qt string")
    index = bm25.build(docs, "doc_id", "text")
    assert got(index, asked, 10) == whole(docs, asked, 10) and len(got(index, asked, 10)) == 3
    assert got(bm25.build(docs.limit(0), "doc_id", "text"), asked, 3) == set()
    assert got(bm25.remove(index, docs, "doc_id"), asked, 3) == set()
    assert got(bm25.add(bm25.build(docs.limit(0), "doc_id", "text"), docs, "doc_id", "text"), asked, 10) == whole(docs, asked, 10)
