"""Intermediate tables in the folder that every executor shares.

A written Parquet table cuts lineage, outlives lost executors and is read back column by column,
so iterative operators use it where a plan would otherwise be recomputed.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named and all runs on one machine a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers on machines that see this folder import the package (clusters get it by --py-files), and keep
    the batches they get small: a batch's words and ids take many times the memory of its texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    root = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{path}".rstrip(":")


def release(spark: SparkSession) -> None:
    """Ask the driver to forget plans that are done: shuffle files stay on disk until it has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            if spark._jsc is not None and not spark._jsc.sc().isStopped():
                _delete(spark, path)
        except Exception:  # the session is going away; what is left belongs to the shared folder's own clean-up
            return


atexit.register(_sweep)


class Scratch:
    """A private subfolder of the shared folder; removed at exit, single tables earlier with drop()."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        _made.append((spark, self.base))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return the table read back, with the same schema."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))
