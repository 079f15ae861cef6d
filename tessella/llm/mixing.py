"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document gets an exponential key divided by its quality weight; in key order a source's documents
are summed up to the part of its target that complete epochs leave over.  No source is sorted as a
whole: keys fall into ``BUCKETS`` ranges, sizes are summed by range, and only the documents of the one
range in which a source's budget ends are ordered.  A source that holds most of the rows costs no more
than its share.

A null text has size 0.  A null source is a source of its own, the last.  Equal rows share a key, so
which of them is taken makes no difference to the rows that come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._util import staged

BUCKETS = 4096
#: Sources up to which their table is broadcast (some tens of bytes each).
BROADCAST_SOURCES = 50_000
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
_WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Words of the whole text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 1, for a text without symbols, down to 0.05."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.05), 1 - 10 * F.coalesce(symbols / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the key's digest, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> and target: shares by weight, none above ``most`` times its size.

    Water filling: by the ratio of limit to weight the first sources are at their limit, and the rest
    share by weight what those leave.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("long"))
    limit = F.lit(most) * F.col("source_size")
    by_ratio = Window.orderBy((limit / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = (
        named.withColumn("full", F.coalesce(F.sum(limit).over(by_ratio), F.lit(0)))
        .withColumn("others", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("left", F.sum("source_size").over(every) - F.col("full"))
        # the first source that its share does not fill sets what a weight is worth
        .withColumn("worth", F.when(F.col("left") * F.col("weight") <= limit * F.col("others"), F.struct(limit / F.col("weight"), "left", "others")))
        .withColumn("worth", F.min("worth").over(every))
    )
    share = F.col("weight") * F.col("worth.left") / F.col("worth.others")
    return filled.select("source", "source_size", F.least(limit.cast("double"), F.coalesce(share, limit.cast("double"))).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, seed: str = "mix-1") -> DataFrame:
    """key, source, size, source_size, target, taken of every row.  Texts are not shuffled."""
    body = F.col(text)
    uneven = uniform(F.col(key), seed)
    rows = df.select(
        F.col(key).alias("k"), F.col(source).cast("string").alias("source"), size_of(body).alias("size"),
        (-F.log(uneven) / (quality_weight(body) if weight is None else weight)).alias("key"),
    )
    rows = staged(rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int")), "mix")
    by_bucket = staged(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sources = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = staged(sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-sources")
    small = sources.count() <= BROADCAST_SOURCES
    near = F.broadcast if small else (lambda x: x)
    # the bucket of each source in which its budget ends, and the words before it
    b = by_bucket.withColumnRenamed("source", "s")
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends = b.join(near(sources), F.col("s").eqNullSafe(F.col("source"))).where("before < rest AND before + words >= rest")
    ends = ends.groupBy("s").agg(F.min(F.struct("bucket", "before")).alias("end"))
    plan = sources.join(near(ends), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "epochs", "rest", F.coalesce("end.bucket", F.lit(-1)).alias("end"), F.coalesce("end.before", F.lit(0)).alias("before"),
    )
    joined = rows.join(near(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = joined.where("bucket <> end").withColumn("extra", F.col("bucket") < F.col("end"))
    order = Window.partitionBy("source").orderBy("key", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = joined.where("bucket = end").withColumn("ahead", ahead).withColumn("extra", 2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest")).drop("ahead")
    taken = F.col("size") * (F.col("epochs") + F.col("extra").cast("long"))
    out = whole.unionByName(part)
    return out.select(F.col("k").alias(key), "source", "size", "source_size", "target", taken.alias("taken"))
