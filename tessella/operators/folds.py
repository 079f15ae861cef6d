"""Operators whose next step depends on the last one: times to live by pointer doubling, and folds that carry state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.operators.tables import forget, written

#: Results of a fold that a task hands on at a time.
FOLD_ROWS = 10_000


def accepted(df: DataFrame, by: Sequence[str], time: str, key: str, ttl: int) -> DataFrame:
    """by, time and key of the accepted rows: of each group the first, then always the first one ``ttl`` or more later.

    Each row points to the one that would be accepted next if it were accepted itself.  With time cut into buckets
    of ``ttl`` this is the first row late enough in the next bucket, or else the first row of the first later
    bucket that has any; so a group is searched bucket by bucket and not in one place.  Rows that nothing points to
    go, as only the first of a group can be accepted without a pointer.  The others are found by doubling: after round
    k the first 2^k rows of each chain are marked, and pointers lead 2^k rows ahead.  No array holds a group, and a
    group of any size is spread over the cluster.

    Rows are ordered by time, then key; equal rows are one.  Rows without a time are never accepted; ``ttl`` is 1 or
    more.
    """
    if ttl < 1:
        raise ValueError("ttl is 1 or more")
    by = list(by)
    e = df.select(*by, F.col(time).cast("long").alias("_t"), F.col(key).alias("_k")).where("_t IS NOT NULL")
    e = e.withColumn("_b", F.expr(f"_t div {ttl} - CASE WHEN _t % {ttl} < 0 THEN 1 ELSE 0 END"))
    event = F.struct("_t", "_k")
    buckets = e.groupBy(*by, "_b").agg(F.min(event).alias("_f"))
    ahead = Window.partitionBy(*by).orderBy("_b")
    far = buckets.select(*by, "_b", *(F.lead(c, n).over(ahead).alias(f"{c}{n}") for c in ("_b", "_f") for n in (1, 2)))
    far = far.select(*by, (F.col("_b") + 1).alias("_b"), F.lit(None).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(e.schema["_k"].dataType).alias("_k"), F.when(F.col("_b1") > F.col("_b") + 1, F.col("_f1")).otherwise(F.col("_f2")).alias("_e"))
    own = e.select(*by, "_b", F.col("_t").alias("_at"), F.lit(1).alias("_kind"), "_k", event.alias("_e"))
    ask = e.select(*by, (F.col("_b") + 1).alias("_b"), (F.col("_t") + ttl).alias("_at"), F.lit(2).alias("_kind"), "_k", F.lit(None).cast(own.schema["_e"].dataType).alias("_e"))
    # from the latest to the earliest: what stands before a question is the first row at or after its time
    back = Window.partitionBy(*by, "_b").orderBy(F.col("_at").desc_nulls_first(), "_kind", F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    found = own.unionByName(ask).unionByName(far).withColumn("_e", F.last("_e", ignorenulls=True).over(back)).where("_kind = 2")
    node = lambda t, k: F.struct(*by, t.alias("t"), k.alias("k"))
    pointers = written(found.select(node(F.col("_at") - ttl, F.col("_k")).alias("id"), F.when(F.col("_e").isNotNull(), node(F.col("_e._t"), F.col("_e._k"))).alias("next")).distinct())
    first = buckets.groupBy(*by).agg(F.min("_f").alias("_f")).select(node(F.col("_f._t"), F.col("_f._k")).alias("id"), F.lit(True).alias("on"))
    named = pointers.where("next IS NOT NULL").select(F.col("next").alias("id"), F.lit(False).alias("on")).distinct()
    nodes = first.unionByName(named).groupBy("id").agg(F.max("on").alias("on"))
    now = written(pointers.join(nodes, "id").select("id", "next", "on"))
    forget(pointers)
    while (marks := now.where("on AND next IS NOT NULL")).limit(1).count():
        hit = marks.select(F.col("next").alias("id"), F.lit(True).alias("hit")).distinct()
        further = now.select(F.col("id").alias("next"), F.col("next").alias("then"))
        then = now.join(further, "next", "left").join(hit, "id", "left").select("id", F.col("then").alias("next"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on"))
        before, now = now, written(then)
        forget(before)
    return now.where("on").select("id.*").select(*by, F.col("t").alias(time), F.col("k").alias(key))


def fold(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], start: tuple, step: Callable[..., tuple], result: Callable[[tuple], tuple], kinds: str) -> DataFrame:
    """One row a group: ``by`` and ``result`` of the state after ``step(state, *values)`` over its rows in order.

    ``kinds`` names the result's columns and types.  A group's rows come sorted, batch by batch, and only the state
    goes from one batch to the next, so memory does not depend on how many rows a group has.  The rows of one group
    are taken one after the other, as the next state needs the last.  Rows of equal order come in any order.
    """
    by, order, values = list(by), list(order), list(values)
    schema = T.StructType([*(df.schema[c] for c in by), *T._parse_datatype_string(kinds).fields])
    arrow = to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[Any, ...] | None = None
        state, out = start, []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            for own, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in values), strict=True), strict=True):
                if own != key:
                    if key is not None:
                        out.append((*key, *result(state)))
                    key, state = own, start
                    if len(out) >= FOLD_ROWS:
                        yield rows()
                        out = []
                state = step(state, *row)
        if key is not None:
            out.append((*key, *result(state)))
        yield rows()

    sent = df.select(*dict.fromkeys([*by, *order, *values])).repartition(*by).sortWithinPartitions(*by, *order)
    return sent.mapInArrow(run, schema)
