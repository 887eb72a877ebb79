"""Tables written between the steps of an operator, where every executor can read them again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lists of the folders that calls of ``released`` remove at their end.
_waiting: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session without one (a test) gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the ``released`` block around it, if there is one."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _waiting:
        _waiting[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what operators have stored within the block. Their results must have been written by then."""
    _waiting.append([])
    try:
        yield
    finally:
        for path in _waiting.pop():
            remove(spark, path)


class Tables:
    """The tables that one call of an operator stores as Parquet in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n, self.paths = spark, new_folder(spark, name), 0, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, read back from files instead of being computed again."""
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove the files of tables that nothing reads any more."""
        for table in tables:
            path, _ = self.paths.pop(id(table))
            remove(self.spark, path)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read back from reliable files instead of being computed again."""
    return Tables(df.sparkSession, "stored").keep(df)
