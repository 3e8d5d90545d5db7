"""A versioned Parquet table: immutable versions and a pointer that is swapped at the end."""

from __future__ import annotations

import json
import os
import shutil
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

try:
    import fcntl
except ImportError:  # no file locks on this system
    fcntl = None


class Store:
    """Versions of one table under a folder; readers pin a version and never see half a write."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    @property
    def pointer(self) -> str:
        return os.path.join(self.folder, "current.json")

    def control(self) -> dict:
        """What the pointer says: version, and what was recorded with it; {} before the first write or if it is damaged."""
        try:
            with open(self.pointer, encoding="utf-8") as f:
                out = json.load(f)
            return out if isinstance(out, dict) and "version" in out else {}
        except (OSError, ValueError):
            return {}

    @contextmanager
    def lock(self):
        """One writer at a time, across processes; raises BlockingIOError while another writes."""
        with open(os.path.join(self.folder, "lock"), "w", encoding="utf-8") as f:
            if fcntl:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            yield

    def read(self, spark: SparkSession, version: str | None = None) -> DataFrame | None:
        version = version or self.control().get("version")
        return spark.read.parquet(os.path.join(self.folder, version)) if version else None

    def write(self, df: DataFrame, **control) -> str:
        """A new version; the pointer moves only when all of it is written, so a failure leaves the old one live."""
        version = f"v{time.time_ns()}-{os.getpid()}"
        path = os.path.join(self.folder, version)
        try:
            df.write.parquet(path)
        except BaseException:
            shutil.rmtree(path, ignore_errors=True)
            raise
        temp = f"{self.pointer}.{os.getpid()}"
        with open(temp, "w", encoding="utf-8") as f:
            json.dump({**control, "version": version}, f, ensure_ascii=False)
        os.replace(temp, self.pointer)
        return version

    def clean(self, keep: int = 2) -> int:
        """Removes versions that are neither current nor among the last ``keep``; returns how many."""
        versions = sorted(x for x in os.listdir(self.folder) if x.startswith("v"))
        live = {self.control().get("version"), *versions[-keep:]}
        gone = [v for v in versions if v not in live]
        for v in gone:
            shutil.rmtree(os.path.join(self.folder, v), ignore_errors=True)
        return len(gone)
