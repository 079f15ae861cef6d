"""A sink for ``foreachBatch`` that takes each batch once, and what stands on it: outboxes, upserts, request bodies.

A batch is written under its own number, and counts once the ledger has a file of that number, which is created last
and in one step.  So a batch that is replayed changes nothing, and one that broke half-way leaves no rows: readers
see committed batches only, and the next attempt clears what is left of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Ledger:
    """Batches of one schema in a folder of a shared file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        path, files = self._path("ledger")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(path)) if files.exists(path) else []

    def write(self, batch: DataFrame, number: int) -> bool:
        """Take a batch; false if it was taken before.  This is the function for ``foreachBatch``."""
        mark, files = self._path(f"ledger/{number}")
        if files.exists(mark):
            return False
        left, files = self._path(f"rows/batch={number}")
        files.delete(left, True)
        batch.write.parquet(f"{self.folder}/rows/batch={number}")
        files.create(mark, False).close()
        return True

    def rows(self, schema: str) -> DataFrame:
        """The rows of committed batches, with ``batch``."""
        found = [f"{self.folder}/rows/batch={n}" for n in self.committed()]
        if not found:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.folder}/rows").parquet(*found)


def run(stream: DataFrame, ledger: Ledger, schema: str) -> DataFrame:
    """Let a stream's batches into the ledger, as far as there are any, and return all its rows."""
    sink = stream.writeStream.foreachBatch(lambda batch, number: ledger.write(batch, number) and None)
    sink.option("checkpointLocation", f"{ledger.folder}/stream").trigger(availableNow=True).start().awaitTermination()
    return ledger.rows(schema)


def states(attempts: DataFrame, key: str, ok: str, most: int = 5) -> DataFrame:
    """key, tries, state over all committed attempts: sent once one succeeds, failed after ``most``, else pending.

    Batches hold what they add; a message's state is a sum over them, so no batch rewrites the state of others.
    """
    a = attempts.groupBy(key).agg(F.count(F.lit(1)).alias("tries"), F.max(F.col(ok).cast("int")).alias("_ok"))
    return a.select(key, "tries", F.when(F.col("_ok") == 1, "sent").when(F.col("tries") >= most, "failed").otherwise("pending").alias("state"))


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last committed batch that has it: what upserts leave."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return found.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values))


def bodies(points: DataFrame, key: str, vector: str, size: int = 100) -> DataFrame:
    """Request bodies of at most ``size`` points each: body, n.  Points are numbered within ranges of their key, not in one place."""
    own = points.select(F.struct(F.col(key).alias("id"), F.col(vector).alias("vector")).alias("p"), F.col(key).alias("_k"), F.spark_partition_id().alias("_s"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy("_k")) - 1
    numbered = own.withColumn("_b", F.floor(place / size))
    return numbered.groupBy("_s", "_b").agg(F.to_json(F.struct(F.collect_list("p").alias("points"))).alias("body"), F.count(F.lit(1)).alias("n")).select("body", "n")


def delivered(requests: DataFrame, body: str, send: Callable[[str, int], bool], most: int = 3) -> DataFrame:
    """The requests with ``tries`` and ``state``: ``send(body, try)`` is called until it succeeds, ``most`` times at most.

    A call that raises counts as one that failed.
    """

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tries, found = [], []
            for b in batch.column(body):
                for n in range(1, most + 1):
                    try:
                        ok = send(b.as_py(), n)
                    except Exception:  # noqa: BLE001  whatever stops a request, it is tried again
                        ok = False
                    if ok or n == most:
                        tries.append(n)
                        found.append("sent" if ok else "failed")
                        break
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tries, pa.int32()), pa.array(found, pa.string())], [*batch.schema.names, "tries", "state"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInArrow(run_, f"{fields}, tries int, state string")
