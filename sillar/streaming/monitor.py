"""Windows over event and health-check streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_counts(events: DataFrame, time: str = "ts", minutes: int = 5) -> DataFrame:
    """Events and errors per tumbling window; works on streams and tables alike."""
    t = F.window(F.col(time).cast("timestamp"), f"{minutes} minutes")
    return events.groupBy(t.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("since"), "event_type", "events", "value")


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """``window_counts`` of the events table read as a stream of files until there is nothing more."""
    static = spark.read.parquet(f"{d}/events.parquet")
    source = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='sillar-stream-')}/windows_{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/table")
    q = window_counts(source).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/table")


def state_stream(checks: DataFrame) -> DataFrame:
    """Consecutive failures and recoveries of a stream of checks, by a state of two values per project.

    checks: project_id, check_time, ok.  Checks of a batch are taken in time order.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames, state: GroupState):
        failures, last_ok = state.get if state.exists else (0, None)
        rows = []
        for x in pd.concat(list(frames)).sort_values("check_time").itertuples():
            recovered = bool(x.ok and failures > 0)
            failures = 0 if x.ok else failures + 1
            last_ok = x.check_time if x.ok else last_ok
            rows.append((key[0], x.check_time, bool(x.ok), failures, recovered))
        state.update((failures, last_ok))
        yield pd.DataFrame(rows, columns=["project_id", "check_time", "ok", "failures", "recovered"])

    return checks.groupBy("project_id").applyInPandasWithState(run, "project_id string, check_time timestamp, ok boolean, failures int, recovered boolean", "failures int, last_ok timestamp", "append", GroupStateTimeout.NoTimeout)
