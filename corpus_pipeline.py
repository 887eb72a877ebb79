"""Five operators applied to the documents one after another, each to all that its predecessor has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontaminate, jaccard_join, mixing, secrets
from marketloom.llm.queries import TOXIC_FROM, table, toxic_score
from marketloom.llm.stored import new_folder, released, remove, stored


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7; the models learn from the labelled documents of sf_dir."""
    return docs.where(toxic_score(spark, docs, sf_dir) < TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id; documents without words stay."""
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    leaks = stored(decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    leaks = F.broadcast(leaks) if leaks.count() <= jaccard_join.MOST_IDS else leaks
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced; n_chars follows the text."""
    found = secrets.find_secrets(docs, model=secrets.fit(docs), out_col="_secrets")
    redacted = secrets.redact(found, secrets_col="_secrets")
    return redacted.withColumn("n_chars", F.when(F.size("_secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, with epoch, weight, place and n_tokens."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", clean_toxicity), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("secrets", redact_secrets), ("mixing", mix)]
#: SQL can express neither the trained models nor the tiling; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and what the stages before have stored is removed."""
    docs, folder, last = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")
        last = name
    return docs
