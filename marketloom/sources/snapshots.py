"""Full snapshots written as changes: only the months whose rows differ from the table's are rewritten.

Beside the rows the table keeps how often each digest of a row occurs in each month. A new snapshot's digests are joined
with them; a month in which any count differs is touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.scratch import stored


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def row_digests(rows: DataFrame, month: str) -> DataFrame:
    """(month, digest, n): how often a month has each row, told by the digest of all its columns."""
    columns = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    return rows.select(F.col(month), F.sha2(columns, 256).alias("digest")).groupBy(month, "digest").agg(F.count("*").alias("n"))


def changes(new: DataFrame, old: DataFrame, month: str) -> DataFrame:
    """(month, added, removed) of every month whose rows differ, for tables of ``row_digests``; a changed row is removed and added."""
    a, b = new.select(F.col(month).alias("_m"), F.col("digest").alias("_d"), F.col("n").alias("_a")), old.select(F.col(month).alias("_m2"), F.col("digest").alias("_d2"), F.col("n").alias("_b"))
    both = a.join(b, F.col("_m").eqNullSafe(F.col("_m2")) & (F.col("_d") == F.col("_d2")), "full")
    more = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    diff = both.select(F.when(F.col("_d").isNotNull(), F.col("_m")).otherwise(F.col("_m2")).alias(month), more.alias("more")).where("more <> 0")
    return diff.groupBy(month).agg(F.sum(F.greatest("more", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("more"), F.lit(0))).alias("removed"))


def refresh(rows: DataFrame, folder: str, month: str = "month") -> DataFrame:
    """Make the table in the folder equal to the snapshot; (month, added, removed) of the months that were rewritten.

    rows are read up to three times and should be stored. Rows may repeat and months be null. If a run breaks off, the next one
    finds the same months different and writes them again, as the digests are written last.
    """
    spark, data, kept = rows.sparkSession, f"{folder}/rows", f"{folder}/digests"
    fs, where = _fs(spark, kept)
    new = stored(row_digests(rows, month))
    old = spark.read.schema(new.schema).parquet(kept) if fs.exists(where) else new.limit(0)
    touched = stored(changes(new, old, month))

    def write(df: DataFrame, path: str) -> None:
        mine = touched.select(F.col(month).alias("_m"))  # a row a month
        some = df.join(F.broadcast(mine), F.col(month).eqNullSafe(F.col("_m"))).drop("_m")
        some.hint("rebalance", month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)

    for df, path in ((rows, data), (new, kept)):
        write(df, path)
        # a month without rows is no partition that a write replaces
        gone = touched.join(new.select(F.col(month).alias("_m")).distinct(), F.col(month).eqNullSafe(F.col("_m")), "left_anti")
        for x in gone.select(F.col(month).cast("string").alias("m")).collect():
            there, at = _fs(spark, f"{path}/{month}={'__HIVE_DEFAULT_PARTITION__' if x['m'] is None else x['m']}")
            there.delete(at, True)
    return touched
