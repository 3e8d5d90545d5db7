"""Cutting lineage in a folder that every executor shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """The frame written by ``checkpoint()`` into the folder of ``spark.checkpoint.dir``.

    The folder is the one the cluster names; only where none is set and the master
    is local (tests) is a temporary one made.  Lost executors are no loss: the
    files are read again.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sillar-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
