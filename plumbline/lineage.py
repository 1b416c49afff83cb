"""Cutting the lineage of iterative plans, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this process's own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return spark.sparkContext.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The frame's rows, written to the shared folder."""
    folder = shared_folder(frame.sparkSession)
    if not frame.sparkSession.sparkContext.getCheckpointDir():
        frame.sparkSession.sparkContext.setCheckpointDir(folder)
    return frame.checkpoint()
