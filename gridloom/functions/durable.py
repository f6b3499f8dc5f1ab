"""Cutting lineage through tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of open scopes, innermost last.
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a purely local session that names none gets its own, deleted when the session's JVM ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    spark.sparkContext.setCheckpointDir(at)
    _path(spark, at)[1].deleteOnExit(_path(spark, at)[0])
    return spark.sparkContext.getCheckpointDir()


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, at: str) -> None:
    path, fs = _path(spark, at)
    fs.delete(path, True)


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are deleted at the end, so results must be used up or written by then.

    Without a scope the tables that a result still reads live as long as the session's JVM.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, at in _SCOPES.pop():
            _delete(spark, at)


class Stage:
    """Tables of one run of an iterative operator, in a folder of their own.

    ``write`` stores a frame as Parquet in the shared folder and returns it read back, so a lost
    executor costs one re-read and never a replay of earlier rounds. ``drop`` deletes a table
    that no later round needs. What a result still reads is deleted at the end of the surrounding
    ``scope``, or else when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        if not self.count and _SCOPES:
            _SCOPES[-1].append((self.spark, self.root))
        self.count += 1
        at = f"{self.root}/{self.count:04d}"
        schema = df.schema
        df.write.parquet(at)
        if self.count == 1:
            path, fs = _path(self.spark, self.root)
            fs.deleteOnExit(path)
        return self.spark.read.schema(schema).parquet(at)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            files = table.inputFiles()
            if files:
                _delete(self.spark, files[0].rpartition("/")[0])


def plan_bytes(df: DataFrame) -> int:
    """Size of a frame as far as the optimizer knows it, without a job; huge where it knows nothing.

    The optimizer multiplies the sides of a join, so the sum of what is read counts if it is less.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), read)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over the cores by the hash of ``keys`` where the input has too few splits for them.

    Meant before work that is heavy per row. Inputs with several splits a core pass unchanged, so
    what is shuffled is bounded by a few splits a core, whatever the size of the data.
    """
    spark = df.sparkSession
    cores = max(1, spark.sparkContext.defaultParallelism)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    parts = max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))  # executors may still be starting
    return df if plan_bytes(df) > parts * split else df.repartition(parts, *keys)
