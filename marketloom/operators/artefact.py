"""A price model with all that scoring needs, kept as numbered versions below a folder.

A version holds the fitted pipeline, the index, the ranges, the comparison by which the model was selected, and, written last,
one row of facts; a version without it was never finished and is not read.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import pricing

FACTS = "version int, model string, location array<string>, trees int, trained_to date, rows long"


@dataclass
class PriceModel:
    version: int
    name: str
    model: PipelineModel
    location: list[str]
    trained_to: dt.date
    rows: int
    index: DataFrame
    ranges: DataFrame
    comparison: DataFrame


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The finished versions, oldest first."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/v*/facts/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(x.getPath().getParent().getParent().getName()[1:]) for x in found or [])


def publish(frame: DataFrame, index: DataFrame, last_month, location: list[str], folder: str, trees: int = 20) -> int:
    """Compare the candidates on the last months, fit the selected one again on all sales, and save it as a new version, whose number is returned.

    frame: as from ``modelling_frame``, read often, so it should be stored.
    """
    spark = frame.sparkSession
    _, predictions = pricing.compete(frame, last_month, location, trees)
    comparison = pricing.compare_models(predictions)
    name = pricing.selected(comparison)
    rows = frame.count()
    model = pricing.candidates(list(location), rows, trees)[name].fit(frame)
    version = max(versions(spark, folder), default=0) + 1
    path = f"{folder}/v{version}"
    model.write().overwrite().save(f"{path}/model")
    index.write.mode("overwrite").parquet(f"{path}/index")
    pricing.price_ranges(predictions.where(F.col("model") == name)).write.mode("overwrite").parquet(f"{path}/ranges")
    comparison.write.mode("overwrite").parquet(f"{path}/comparison")
    facts = spark.createDataFrame([(version, name, list(location), trees, last_month, rows)], FACTS)
    facts.write.mode("overwrite").parquet(f"{path}/facts")
    return version


def load(spark: SparkSession, folder: str, version: int | None = None) -> PriceModel:
    """A version, by default the newest finished one."""
    found = versions(spark, folder)
    if not found or version is not None and version not in found:
        raise ValueError(f"no finished version {version or ''} below {folder}")
    path = f"{folder}/v{version or found[-1]}"
    x = spark.read.parquet(f"{path}/facts").first()
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return PriceModel(x["version"], x["model"], PipelineModel.load(f"{path}/model"), list(x["location"]), x["trained_to"], x["rows"], read("index"), read("ranges"), read("comparison"))
