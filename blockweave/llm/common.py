"""Helpers shared by the training-data operators: tables, scratch storage, row-bounded batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes A-Z to a-z; every other byte, and so every other character of UTF-8, stays.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share. Only where the session names none and runs on one machine (tests) is a local one
    made; on a cluster without the setting this is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='blockweave-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended; the shared folder's own retention takes over
        pass


class Scratch:
    """Intermediate tables of one run in the shared folder: they cut lineage, survive a lost executor and are not recomputed."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(_delete_at_exit, spark, self.base)

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        path = f"{self.base}/{self._n}"
        self._n += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._blockweave_path = path
        return out

    def write_small(self, df: DataFrame, rows: int, each: int = 100_000, last: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """``write`` of ``last(df)``, where ``df`` has about ``rows`` rows at most, in few tasks: one for each core or for each
        ``each`` rows, whichever are more. Meant for narrow rows, of which a shuffle's partitions would hold few."""
        return self.write(last(df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // each)))))

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._blockweave_path)


def bounded(rows: DataFrame, count: int | None = None, most: int = 500_000) -> DataFrame:
    """A hint to broadcast a written table of a few numbers a row if its row count allows; beyond it, Spark shuffles."""
    return F.broadcast(rows) if (rows.count() if count is None else count) <= most else rows


def over_arrow(f: Callable) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that applies ``f`` to each record batch."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            yield f(b)

    return run
