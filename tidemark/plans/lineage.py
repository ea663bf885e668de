"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where it is unset and all runs on this machine, as in tests, a temporary folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not found and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidemark-"))
        current = sc._jsc.sc().getCheckpointDir()
    return found or current.get()


def cut(df: DataFrame) -> DataFrame:
    """df evaluated once, by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
