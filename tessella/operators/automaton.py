"""Which of many patterns does a text contain: one automaton for all of them, run once over each text.

Patterns are sent to the workers behind a check of their number; larger sets are taken in blocks by the hash of the
pattern, each with an automaton of its own.  Texts are read once a block and never compared with pattern by pattern.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Patterns of one automaton.
PATTERN_BLOCK = 200_000


def automaton(patterns: Sequence[str]) -> ahocorasick.Automaton:
    """Of patterns that are not empty; each gives its number."""
    found = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        found.add_word(p, i)
    if patterns:
        found.make_automaton()
    return found


def contained(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of ``texts`` and the columns of ``patterns``: a row for each text and pattern it contains.

    As in SQL an empty pattern is in every text, and nothing is in a null or contains one.  Patterns that are repeated
    give a row each; a text that holds one several times gives one.
    """
    distinct = patterns.select(F.col(pattern).alias("_p")).where("_p IS NOT NULL").distinct()
    n = distinct.count()
    blocks = 1 if n <= PATTERN_BLOCK else -(-2 * n // PATTERN_BLOCK)
    own = texts.select(*keep, F.col(text).alias("_t"))
    schema = T.StructType([*(own.schema[c] for c in keep), T.StructField("_p", T.StringType())])
    arrow = to_arrow_schema(schema)

    def one(block: int) -> DataFrame:
        some = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("_p"), F.lit(blocks)) == block)
        listed = [r[0] for r in some.collect()]  # PATTERN_BLOCK at most, on average half of it
        sent = texts.sparkSession.sparkContext.broadcast([p for p in listed if p])
        everywhere = [""] * (len(listed) - len(sent.value))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = sent.value
            machine = automaton(words)
            for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
                rows, found = [], []
                for i, t in enumerate(batch.column("_t")):
                    t = t.as_py()
                    if t is None:
                        continue
                    hits = [words[j] for j in {j for _, j in machine.iter(t)}] if words else []
                    rows += [i] * (len(hits) + len(everywhere))
                    found += hits + everywhere
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at).cast(arrow.field(c).type) for c in keep), pa.array(found, pa.string())], schema=arrow)

        return own.mapInArrow(run, schema)

    met = reduce(DataFrame.unionByName, map(one, range(blocks)))
    extra = [c for c in patterns.columns if c != pattern]
    if not extra:
        return met.withColumnRenamed("_p", pattern)
    return met.join(patterns.withColumnRenamed(pattern, "_p"), "_p").select(*keep, F.col("_p").alias(pattern), *extra)
