"""Health-check history: streaks, recoveries, bounded history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def once(checks: DataFrame) -> DataFrame:
    """One row per project and time, the one received last."""
    return checks.groupBy("project_id", "check_time").agg(F.max_by(F.struct("ok", "seconds", "error"), "received_at").alias("v")).select("project_id", "check_time", "v.*")


def streaks(checks: DataFrame) -> DataFrame:
    """Each check with its consecutive failures so far, whether it is a recovery, and the last time that was well."""
    w = Window.partitionBy("project_id").orderBy("check_time")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = checks.withColumn("_island", F.sum(F.col("ok").cast("int")).over(upto))
    inside = Window.partitionBy("project_id", "_island").orderBy("check_time").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("failures", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(inside))
        .withColumn("recovered", F.col("ok") & F.coalesce(~F.lag("ok").over(w), F.lit(False)))
        .withColumn("last_ok", F.max(F.when(F.col("ok"), F.col("check_time"))).over(upto))
        .drop("_island")
    )


def recent(checks: DataFrame, n: int = 50) -> DataFrame:
    """The last n checks of each project."""
    w = Window.partitionBy("project_id").orderBy(F.desc("check_time"))
    return checks.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)
