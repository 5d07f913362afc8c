"""Reliable cuts of long lineages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; a local one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder as Parquet: a fraction of the size of a checkpoint, and of it only the columns asked for are read.

    The files stay until the folder goes.
    """
    folder = f"{shared(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
