"""Tables and the derived tables that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``us``, microseconds since the epoch."""
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): customer to nation to region."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    return c.unionByName(n)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, weight): part to supplier with the count of lines."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target")).agg(F.count(F.lit(1)).alias("weight"))


HIERARCHY_SQL = "SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"
TRADE_SQL = "SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, count(*) AS weight FROM lineitem GROUP BY 1, 2"
