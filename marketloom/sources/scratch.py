"""Tables written between the steps of an operator, where every executor can read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session without one (a test) gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read back from reliable checkpoint files instead of being computed again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet files: for large tables that are read several times, since a reader takes only the
    columns that it needs and unpacks them in batches."""
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def at_once(jobs: list, threads: int = 4) -> list:
    """The results of functions that run Spark jobs, in order; up to so many run side by side, so that small ones fill the executors."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.sql import SparkSession

    inherits = inheritable_thread_target(SparkSession.active())
    with ThreadPool(max(1, min(threads, len(jobs)))) as pool:
        return pool.map(lambda job: job(), [inherits(job) for job in jobs])
