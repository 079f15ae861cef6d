"""Set similarity over shared elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jaccard_pairs(df: DataFrame, key: str, elements: str, above: float) -> DataFrame:
    """(a, b, j) of all pairs of keys a < b with a Jaccard similarity above a bound.

    Elements are ordered by how many sets hold them, rarest first.  Two sets above the bound share one of
    the first ``n - ceil(above * n) + 1`` elements of each, so only those are joined on, between sets whose
    sizes allow the bound; what meets is compared whole.
    """
    sized = df.select(F.col(key).alias("k"), F.col(elements).alias("es"), F.size(elements).alias("n")).where("n > 0")
    flat = sized.select("k", "n", F.explode("es").alias("e"))
    often = flat.groupBy("e").agg(F.count(F.lit(1)).alias("f"))
    ranked = flat.join(often, "e").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("fs"))
    first = F.slice("fs", 1, (F.col("n") - F.ceil(F.col("n") * above) + 1).cast("int"))
    prefix = ranked.select("k", "n", F.explode(first).alias("x")).select("k", "n", "x.e")
    a, b = (prefix.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), "e") for x in "ab")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= above * F.greatest("na", "nb"))
    met = a.join(b, "e").where(fits).select("a", "b").distinct()
    sets_a, sets_b = (sized.select(F.col("k").alias(x), F.col("es").alias(f"e{x}")) for x in "ab")
    both = met.join(sets_a, "a").join(sets_b, "b").withColumn("i", F.size(F.array_intersect("ea", "eb")))
    return both.select("a", "b", (F.col("i") / (F.size("ea") + F.size("eb") - F.col("i"))).alias("j")).where(F.col("j") > above)
