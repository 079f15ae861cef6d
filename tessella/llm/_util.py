"""Session helpers: the shared folder and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in a session without it an own one.

    A machine-local folder serves only where the session is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set, and a local folder does not serve a cluster")
    folder = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` written as Parquet to the shared folder and read again.

    It cuts lineage and survives lost executors.  The files go with ``discard``, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.parquet(path)
    out.__dict__["_staged_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again."""
    for t in tables:
        path = t.__dict__.pop("_staged_path", None)
        if path:
            _remove(t.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


#: Bytes of an Arrow batch that goes to a Python worker; both sides hold several at a time.
BATCH_BYTES = 4 << 20


def slim(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``BATCH_BYTES``, which this sets where they hold more."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name)).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, rows: int, seed: int = 5) -> DataFrame:
    """About ``rows`` rows of ``df``, each drawn by itself, so that no task gathers them."""
    total = df.count()
    return df if total <= rows else df.sample(rows / total, seed)
