"""A corpus pipeline: documents through five operators, one after the other.

Stages, each on all that its predecessor kept, and each but the last with the columns of documents:
quality rules (rejected documents go), near duplicates on five-word shingles with a similarity of 0.8 or
more (the document of each class with the smallest id stays), benchmark decontamination (documents
that contain an item go), secret scans (secrets in texts are replaced, ``n_chars`` follows), and the
mix of sources to target weights.

Documents without text or with an empty one have fewer than 50 words and are rejected by the quality rules.  Rows without
an id belong to no class of near duplicates and stay; of rows with equal ids and texts one stays, of other copies the one
with the smallest id.  A null source is a source of its own.  Very long texts are taken whole.  Further columns, whatever
their names, pass through all stages but the last.  Of an empty table nothing comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, mixing, ngram_join, quality, secrets
from tessella.llm._util import discard, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs, n=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact_secrets(docs, labels=table(spark, sf_dir, "labels"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
