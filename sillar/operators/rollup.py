"""Folder trees, histograms and the bottom-up roll-up of file purposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillar.functions.text import LEVELS, shorten


def ancestors(path: Column) -> Column:
    """All folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def folder_counts(files: DataFrame, group: list[str]) -> DataFrame:
    """(group, folder, depth, files, direct_files): descendants and direct members of every folder."""
    rows = files.select(*group, "path", F.explode(ancestors(F.col("path"))).alias("folder"))
    direct = (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))) == F.size(F.split("folder", "/"))
    return rows.groupBy(*group, "folder").agg(F.count("*").alias("files"), F.count_if(direct).alias("direct_files")).withColumn("depth", F.size(F.split("folder", "/")))


def extension_histogram(files: DataFrame, group: list[str], top: int = 8) -> DataFrame:
    """The most frequent extensions, ties by the first path: (group, ext, n, place)."""
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1)), F.lit("")), F.lit("(none)"))
    counts = files.select(*group, ext.alias("ext"), "path").groupBy(*group, "ext").agg(F.count("*").alias("n"), F.min("path").alias("_first"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "_first")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("_first")


def rollup_levels(purposes: DataFrame, group: list[str], budget: int, depth: int | None = None) -> DataFrame:
    """Text and hash of every folder, deepest first: (group, folder, depth, text, digest, copied).

    A folder of one file, or of one subfolder and no file, copies that text; others
    list their files and subfolders, shortened level by level until they fit the
    budget.  One join a level: ``depth`` bounds the loop, not the number of rows;
    without it the loop begins at the deepest folder.
    purposes: group, path, purpose.
    """
    if depth is None:
        depth = max(1, purposes.agg(F.max(F.size(F.split("path", "/")) - 1)).first()[0] or 1)
    files = purposes.withColumn("parent", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(""))
    names = F.element_at(F.split("path", "/"), -1)
    entries = files.where("parent <> ''").select(*group, F.col("parent").alias("folder"), F.lit(0).alias("kind"), names.alias("name"), F.col("purpose").alias("text"), F.lit(0).alias("sub"))
    known = entries.withColumn("depth", F.size(F.split("folder", "/")))
    done = None
    carried = None
    for level in range(depth, 0, -1):
        here = known.where(F.col("depth") == level)
        if carried is not None:
            here = here.unionByName(carried)
        line = lambda n: F.concat(F.col("name"), F.when(F.col("kind") == 1, F.lit("/")).otherwise(F.lit("")), F.lit(": "), shorten(F.col("text"), n))  # noqa: E731, B023
        items = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "name", line(n).alias("line")))), lambda x: x["line"]), "\n").alias(f"t{n}") for n in LEVELS]
        agg = here.groupBy(*group, "folder").agg(*items, F.count_if(F.col("kind") == 0).alias("files"), F.count_if(F.col("kind") == 1).alias("subs"), F.max("text").alias("only"))
        fits = [F.when(F.length(f"t{n}") <= budget, F.col(f"t{n}")) for n in LEVELS]
        copied = (F.col("files") + F.col("subs")) == 1
        text = F.when(copied, shorten(F.col("only"), LEVELS[0])).otherwise(F.coalesce(*fits, F.substring(f"t{LEVELS[-1]}", 1, budget)))
        folders = agg.select(*group, "folder", F.lit(level).alias("depth"), text.alias("text"), F.sha1(F.concat(F.lit("1"), text).cast("binary")).alias("digest"), copied.alias("copied"))
        done = folders if done is None else done.unionByName(folders)
        if level > 1:
            carried = folders.select(*group, F.regexp_replace("folder", "/[^/]*$", "").alias("folder"), F.lit(1).alias("kind"), F.element_at(F.split("folder", "/"), -1).alias("name"), "text", F.lit(1).alias("sub"), F.lit(level - 1).alias("depth"))
    return done
