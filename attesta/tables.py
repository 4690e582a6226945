"""Intermediate tables: what a later plan reads more than once is written to a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed now and read back from Parquet: plans on them start anew, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attesta/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote for frames that no later plan reads."""
    for df in frames:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
