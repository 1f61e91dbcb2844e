"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, a local session takes a temporary one; a cluster, whose executors
    could not read that, is refused."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="oxbow-checkpoint-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place below the checkpoint folder, which the driver and all executors share."""
    return f"{ensure(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df`, written to the checkpoint folder, so that it is evaluated once and a lost executor costs a read."""
    ensure(df.sparkSession)
    return df.checkpoint(eager=True)
