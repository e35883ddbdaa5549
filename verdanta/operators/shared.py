"""Reliable checkpoints, always in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder is set, but only in local mode: on a cluster a
    machine-local folder would be invisible to the other executors.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = sc.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="verdanta-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with an eager, reliable checkpoint: lost executors don't lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
