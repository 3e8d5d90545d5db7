"""A watcher that keeps an index of files up to date, micro-batch by micro-batch."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillar.operators.changes import merge
from sillar.sources.store import Store


def sync_batch(store: Store, batch: DataFrame, batch_id: int) -> None:
    """Merges the files of a batch into the store; a batch that was merged before is left out."""
    with store.lock():
        if store.control().get("batch", -1) >= batch_id:
            return
        w = Window.partitionBy("project_id", "path").orderBy(F.col("ingested_at").desc_nulls_last())
        fresh = batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("project_id", "path", F.md5(F.col("content").cast("binary")).alias("digest"), "ingested_at")
        live = store.read(batch.sparkSession)
        gone = fresh.where("digest is null").select("project_id", "path")
        rows = fresh if live is None else merge(live, fresh, ["project_id", "path"])
        store.write(rows.join(gone, ["project_id", "path"], "left_anti"), batch=batch_id)
        store.clean()


def watch(source: DataFrame, store: Store, checkpoint: str, **trigger):
    """Starts the watcher; ``trigger``: processingTime='300 seconds' to go on, availableNow=True for one round."""
    return source.writeStream.foreachBatch(lambda b, i: sync_batch(store, b, i)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def sync_all(spark: SparkSession, d: str) -> DataFrame:
    """Projects and files of the index after a stream read all of ``repo_files``."""
    static = spark.read.parquet(f"{d}/repo_files.parquet")
    folder = os.path.join((spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sillar-watch-")).removeprefix("file://").removeprefix("file:"), uuid.uuid4().hex)
    path = f"{d}/repo_files.parquet"
    source = spark.readStream.schema(static.schema)
    source = source.parquet(path) if os.path.isdir(path) else source.option("pathGlobFilter", "repo_files.parquet").parquet(d)
    store = Store(os.path.join(folder, "index"))
    watch(source, store, os.path.join(folder, "progress"), availableNow=True).awaitTermination()
    return store.read(spark).groupBy("project_id").agg(F.count("*").alias("files"), F.countDistinct("digest").alias("contents"))
