"""Layered tables: names, writing, reading, documentation and the serving extract."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYER = re.compile(r"(bronze|silver|gold)_[a-z0-9_]+")


def checked(name: str) -> str:
    if not LAYER.fullmatch(name):
        raise ValueError(f"table names begin with bronze_, silver_ or gold_: {name}")
    return name


def write_table(df: DataFrame, name: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Overwrite with a full snapshot (the schema may change) or append."""
    if mode not in ("overwrite", "append"):
        raise ValueError(mode)
    w = df.write.mode(mode).option("overwriteSchema", "true")
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(checked(name))


def read_table(spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
    """The table; if it does not exist and a schema is given, an empty frame (an optional input)."""
    if schema is not None and not spark.catalog.tableExists(checked(name)):
        return spark.createDataFrame([], schema)
    return spark.table(checked(name))


def describe_table(spark: SparkSession, name: str, comment: str, source: str) -> None:
    quoted = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"COMMENT ON TABLE {checked(name)} IS '{quoted(comment)}'")
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('layer' = '{name.split('_')[0]}', 'source' = '{quoted(source)}')")


def table_facts(spark: SparkSession, name: str) -> dict[str, str]:
    """What ``describe_table`` has noted: comment, layer and source (those that are set)."""
    facts = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {checked(name)}").collect() if r["key"] in ("layer", "source")}
    comment = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Comment'").first()
    return facts | ({"comment": comment["data_type"]} if comment else {})


def publish(tables: dict[str, tuple[DataFrame, list[str]]], folder: str) -> DataFrame:
    """Write each table's serving columns as Parquet below folder; the manifest (table, rows) is written as JSON and returned."""
    spark = next(iter(tables.values()))[0].sparkSession
    rows = []
    for name, (df, columns) in tables.items():
        df.select(columns).write.mode("overwrite").parquet(f"{folder}/{name}")
        rows.append((name, spark.read.parquet(f"{folder}/{name}").count()))
    manifest = spark.createDataFrame(rows, "table string, rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def _plain(x: Column, t: T.DataType) -> Column:
    """The value with null in place of NaN and infinite numbers, inside structs, arrays and maps too."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    if isinstance(t, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[_plain(x.getField(f.name), f.dataType).alias(f.name) for f in t]))
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda e: _plain(e, t.elementType))
    return F.transform_values(x, lambda _, v: _plain(v, t.valueType)) if isinstance(t, T.MapType) else x


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON text; NaN and infinite numbers become null."""
    return df.select(F.to_json(F.struct(*[_plain(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]), {"ignoreNullFields": "false"}).alias("json"))
