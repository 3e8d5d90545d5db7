"""Files and change sets of a git repository, through the git binary."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillar.functions.predicates import is_indexable
from sillar.sources.tables import tasks

TREE = "mode string, blob string, path string"


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def resolve(repo: str, ref: str = "HEAD") -> str | None:
    try:
        return _git(repo, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").decode().strip()
    except subprocess.CalledProcessError:
        return None


def tree(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    """(mode, blob, path) of the indexable regular files of a commit."""
    rows = []
    for entry in _git(repo, "ls-tree", "-r", "-z", commit).split(b"\0"):
        if entry:
            meta, path = entry.split(b"\t", 1)
            mode, kind, blob = meta.decode().split()
            if kind == "blob" and mode != "120000":
                rows.append((mode, blob, path.decode("utf-8", "replace")))
    return spark.createDataFrame(rows, TREE).where(is_indexable(F.col("path")))


def contents(spark: SparkSession, repo: str, files: DataFrame) -> DataFrame:
    """The files with their content as of the commit, invalid bytes dropped; blobs are read on the executors, which see the clone."""

    def run(batches):
        for b in batches:
            data = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="\n".join(b["blob"]).encode() + b"\n", check=True, capture_output=True).stdout
            at, out = 0, []
            for _ in range(len(b)):
                end = data.index(b"\n", at)
                head = data[at:end].split()
                if len(head) == 2:
                    out.append(None)
                    at = end + 1
                    continue
                size = int(head[2])
                out.append(data[end + 1 : end + 1 + size].decode("utf-8", "ignore"))
                at = end + 2 + size
            b["content"] = out
            yield b[["path", "blob", "content"]]

    return files.repartition(tasks(spark), "path").mapInPandas(run, "path string, blob string, content string")


def changes(spark: SparkSession, repo: str, base: str | None, target: str) -> tuple[DataFrame, bool]:
    """((change, old_key, new_key) between two commits, whether all is to be read anew).

    A base that is missing or cannot be found gives the whole tree as added.
    """
    from sillar.operators.changes import change_set

    new = tree(spark, repo, target)
    found = resolve(repo, base) if base else None
    if found is None:
        return new.select(F.lit("A").alias("change"), F.lit(None).cast("string").alias("old_key"), F.col("path").alias("new_key")), True
    return change_set(tree(spark, repo, found), new, "path", "blob"), False
