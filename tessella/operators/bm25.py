"""Keyword search over a stored inverted index: blocks of postings with bounds, and a top-k that skips blocks.

``build`` reads texts once.  Documents are dealt into segments by the hash of their key; a block holds a term's
postings in a segment, with the largest count and the shortest document in it, which bound what the block can add to a
score whatever the average length becomes.  ``search`` takes a query's terms in order of their bounds.  The strong
ones give partial scores; the k-th best is a threshold.  All terms whose bounds together stay under it cannot lift a
document on their own, so their blocks are read only where a segment holds a document that can still reach the
threshold.  Results are exact.

A null text has no terms but counts as a document.  Keys name documents and are not repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import tokens_bm25
from tessella.operators.retrieval import top
from tessella.operators.tables import forget, written

K1, B = 1.5, 0.75
SEGMENT_DOCS = 2048
#: Share of a query's bounds that its strong terms make up.
STRONG = 0.6
#: Sums of the same parts in another order differ by less.
_DUST = 1e-7


@dataclass
class Index:
    """``blocks``: term, segment, n, most_tf, least_dl, and arrays docs, tfs, dls; ``docs``: doc, dl, segment."""

    blocks: DataFrame
    docs: DataFrame

    def drop(self) -> None:
        forget(self.blocks, self.docs)


def build(docs: DataFrame, key: str, text: str, segment_docs: int = SEGMENT_DOCS) -> Index:
    """The index of all documents, written to the shared folder.

    Texts are shuffled once, by segment; tokens, postings and blocks are then made where the segment is.
    """
    segments = max(1, -(-docs.count() // segment_docs))
    own = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).withColumn("segment", F.pmod(F.xxhash64("doc"), F.lit(segments)).cast("int"))
    counted = own.repartition("segment").select("segment", "doc", F.coalesce(tokens_bm25(F.col("text")), F.array()).alias("ts"))
    counted = counted.select("segment", "doc", "ts", F.size("ts").alias("dl"))
    postings = counted.select("segment", "doc", "dl", F.explode("ts").alias("term")).groupBy("segment", "term", "doc", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    return Index(_blocks(postings), written(counted.select("doc", "dl", "segment")))


def _blocks(postings: DataFrame) -> DataFrame:
    """Blocks of postings (term, segment, doc, tf, dl), each of a segment's documents at most, neighbours in a file by term."""
    listed = postings.groupBy("segment", "term").agg(F.array_sort(F.collect_list(F.struct("doc", "tf", "dl"))).alias("p"))
    made = listed.select("term", "segment", F.size("p").alias("n"), F.array_max("p.tf").alias("most_tf"), F.array_min("p.dl").alias("least_dl"), F.col("p.doc").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
    return written(made.sortWithinPartitions("term"))


def add(index: Index, docs: DataFrame, key: str, text: str, segment_docs: int = SEGMENT_DOCS) -> Index:
    """The index with further documents, in segments of their own; no block that is there is read."""
    more = build(docs, key, text, segment_docs)
    after = (index.docs.agg(F.max("segment")).first()[0] or 0) + 1
    moved = Index(*(written(new.withColumn("segment", F.col("segment") + after)) for new in (more.blocks, more.docs)))
    more.drop()
    return Index(index.blocks.unionByName(moved.blocks), index.docs.unionByName(moved.docs))


def remove(index: Index, gone: DataFrame, key: str) -> Index:
    """The index without some documents: blocks of segments that hold none of them stay as they are."""
    gone = gone.select(F.col(key).alias("doc")).distinct()
    hit = index.docs.join(gone, "doc", "left_semi").select("segment").distinct()
    postings = index.blocks.join(hit, "segment", "left_semi").select("term", "segment", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
    left = postings.select("term", "segment", F.col("p.docs").alias("doc"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")).join(gone, "doc", "left_anti")
    return Index(index.blocks.join(hit, "segment", "left_anti").unionByName(_blocks(left)), written(index.docs.join(gone, "doc", "left_anti")))


def _part(tf: Column, dl: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def search(index: Index, queries: DataFrame, query: str, text: str, k: int = 10, digits: int = 9) -> DataFrame:
    """query, doc, score, rank: the ``k`` best documents by the score rounded to ``digits``; ties go to the smaller key."""
    return searched(index, queries, query, text, k, digits)[0]


def searched(index: Index, queries: DataFrame, query: str, text: str, k: int = 10, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """``search``'s rows, and for each query the blocks read and the blocks that its terms have."""
    if k < 1:
        raise ValueError("k is 1 or more")
    n, mean = index.docs.agg(F.count(F.lit(1)), F.avg("dl")).first()
    mean = mean or 1.0
    asked = queries.select(query, F.explode(tokens_bm25(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qn"))
    bound = _part(F.col("most_tf"), F.col("least_dl"), mean)
    known = index.blocks.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"), F.max(bound).alias("bound"), F.count(F.lit(1)).alias("blocks"))
    weight = F.col("qn") * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    by_bound = Window.partitionBy(query).orderBy(F.desc("most"), "term")
    terms = asked.join(known, "term").select(query, "term", "blocks", weight.alias("weight"), (weight * F.col("bound")).alias("most"))
    before = F.coalesce(F.sum("most").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("most").over(by_bound.rowsBetween(0, Window.unboundedFollowing))
    terms = written(terms.select("*", before.alias("before"), after.alias("after"), F.sum("most").over(Window.partitionBy(query)).alias("whole")))

    def scored(some: DataFrame) -> DataFrame:
        """query, doc, score of the blocks of terms."""
        met = index.blocks.join(some.select(query, "term", "weight"), "term").select(query, "segment", "weight", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
        return met.groupBy(query, F.col("p.docs").alias("doc"), "segment").agg(F.sum(F.col("weight") * _part(F.col("p.tfs"), F.col("p.dls"), mean)).alias("score"))

    def threshold(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score")))
        return found.withColumn("place", place).where(F.col("place") == k).select(query, F.col("score").alias("least"))

    strong = F.col("before") < STRONG * F.col("whole")
    first = written(scored(terms.where(strong)))
    # a term is needed if it and all weaker ones could lift a document to the threshold
    judged = terms.join(threshold(first), query, "left").select(query, "term", "weight", "most", "blocks", strong.alias("strong"), (strong | (F.col("after") >= F.coalesce("least", F.lit(0.0)) - _DUST)).alias("full"))
    judged = written(judged)
    more = scored(judged.where("full AND NOT strong"))
    partial = written(first.unionByName(more).groupBy(query, "doc", "segment").agg(F.sum("score").alias("score")))
    rest = judged.where("NOT full")
    left = rest.groupBy(query).agg(F.sum("most").alias("left"))
    open_ = partial.join(threshold(partial), query, "left").join(left, query, "left")
    open_ = (open_.where(F.col("score") + F.coalesce("left", F.lit(0.0)) >= F.coalesce("least", F.lit(0.0)) - _DUST).select(query, "doc", "segment", "score"))
    near = open_.join(left.select(query), query, "left_semi").select(query, "segment").distinct()
    wanted = near.join(rest.select(query, "term", "weight"), query)
    blocks = index.blocks.join(wanted, ["term", "segment"])
    late = blocks.select(query, "weight", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")).select(query, F.col("p.docs").alias("doc"), (F.col("weight") * _part(F.col("p.tfs"), F.col("p.dls"), mean)).alias("score"))
    late = late.join(open_.select(query, "doc"), [query, "doc"], "left_semi")
    whole = open_.select(query, "doc", "score").unionByName(late).groupBy(query, "doc").agg(F.round(F.sum("score"), digits).alias("score"))
    read = judged.groupBy(query).agg(F.sum(F.when(F.col("full"), F.col("blocks")).otherwise(0)).alias("read"), F.sum("blocks").alias("blocks"))
    read = read.join(blocks.groupBy(query).agg(F.count(F.lit(1)).alias("late")), query, "left").select(query, (F.col("read") + F.coalesce("late", F.lit(0))).alias("read"), "blocks")
    return top(whole, [query], "doc", k), read
