"""Tables that iterative operators write between rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` by a reliable checkpoint, which cuts lineage and outlives executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/tessella-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: an index to be read more than once.

    Its size is known to the planner, other than a checkpoint's.  The table goes when the driver's Python ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.__dict__["_path"] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing will read again."""
    for t in tables:
        path = t.__dict__.pop("_path", None)
        if path:
            drop(t.sparkSession, path)


def drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session has cores at least, so that a file of one row group is no one task's."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
