"""Reading the tables of a corpus folder, and spreading work over its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Partitions for CPU-bound work: at least three for every core, more where the session asks for more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by a key of high cardinality over a fixed number of partitions.

    Few large input splits would leave most cores idle under CPU-bound Python; the
    number is explicit, so adaptive execution does not merge the partitions again.
    """
    return df.repartition(tasks(df.sparkSession), *keys)


def latest(df: DataFrame, keys: list[str], value: str, time: str = "ingested_at") -> DataFrame:
    """One row per key with the value of its latest row; rows without a time count as oldest.

    Of rows of one time the greatest value stays, so the result does not depend on
    the order of rows.  ``value`` must be small (a verdict, not a text) and of a
    type that can be ordered: partial aggregation keeps one per key and task, and
    a hot key costs one row a task.
    """
    at = F.coalesce(F.col(time), F.lit("0001-01-01").cast("timestamp"))
    return df.groupBy(*keys).agg(F.max(F.struct(at.alias("at"), F.col(value).alias("value"))).alias("_l")).select(*keys, F.col("_l.value").alias(value))


def extension(path) -> F.Column:
    """The lower-cased suffix of the last path component, dot included; '' where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))
