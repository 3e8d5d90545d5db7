"""Change sets between snapshots, merges, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_set(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """(change, old_key, new_key): A, M, D, and R for a deleted and an added row of equal, unambiguous content.

    One full outer join on the key; renames join the deleted and added rows on
    their digest, each digest reduced to one row a side first, so equal contents
    never multiply.
    """
    o, n = old.select(F.col(key).alias("ok"), F.col(digest).alias("od")), new.select(F.col(key).alias("nk"), F.col(digest).alias("nd"))
    joined = o.join(n, F.col("ok") == F.col("nk"), "full_outer")
    kind = F.when(F.col("ok").isNull(), "A").when(F.col("nk").isNull(), "D").when(~F.col("od").eqNullSafe(F.col("nd")), "M")
    changes = joined.withColumn("change", kind).where(F.col("change").isNotNull())
    gone = changes.where("change = 'D'").groupBy("od").agg(F.min("ok").alias("ok"), F.count("*").alias("c")).where("c = 1").drop("c")
    came = changes.where("change = 'A'").groupBy("nd").agg(F.min("nk").alias("nk"), F.count("*").alias("c")).where("c = 1").drop("c")
    renamed = gone.join(came, F.col("od") == F.col("nd")).select(F.lit("R").alias("change"), F.col("ok").alias("old_key"), F.col("nk").alias("new_key"))
    plain = changes.select("change", F.col("ok").alias("old_key"), F.col("nk").alias("new_key"))
    moved = renamed.select(F.col("old_key").alias("_o"), F.col("new_key").alias("_n"))
    rest = plain.join(moved.select("_o"), (F.col("change") == "D") & (F.col("old_key") == F.col("_o")), "left_anti").join(moved.select("_n"), (F.col("change") == "A") & (F.col("new_key") == F.col("_n")), "left_anti")
    return rest.unionByName(renamed)


def to_reindex(changes: DataFrame) -> DataFrame:
    return changes.where("change in ('A', 'M', 'R')").select(F.col("new_key").alias("key"))


def to_purge(changes: DataFrame) -> DataFrame:
    return changes.where("change in ('D', 'R')").select(F.col("old_key").alias("key"))


def merge(live: DataFrame, fresh: DataFrame, keys: list[str], purge: DataFrame | None = None) -> DataFrame:
    """live without purged and replaced rows, and the fresh rows: applying it twice changes nothing more."""
    kept = live.join(fresh.select(*keys).distinct(), keys, "left_anti")
    if purge is not None:
        kept = kept.join(purge, list(purge.columns), "left_anti")
    return kept.unionByName(fresh)
