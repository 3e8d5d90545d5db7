"""The tables of a corpus folder, each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillar.sources.tables import load


def _once(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return _once(load(spark, d, "chunks"), ["project_id", "chunk_id"], "ingested_at")


def files(spark: SparkSession, d: str) -> DataFrame:
    return _once(load(spark, d, "repo_files"), ["project_id", "path"], "ingested_at")


def asks(spark: SparkSession, d: str) -> DataFrame:
    return _once(load(spark, d, "asks"), ["ask_id"], "received_at")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents")
