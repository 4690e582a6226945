"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the characters that part words, as a character class.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters, for trimming.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attesta/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them back.

    Unlike ``checkpoint()`` this computes the plan once, keeps the columns compressed, and a lost executor loses nothing.
    """
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what ``saved`` wrote for frames that no later plan reads."""
    for df in frames:
        remove(df.sparkSession, df.saved_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are done with (it acts when their objects are collected)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidied(run):
    """A function over Arrow batches that gives Arrow's unused memory back before and after: Python workers live on, and their
    pools keep what earlier tasks needed, other stages' too."""

    def tidy(batches):
        pool = pa.default_memory_pool()
        pool.release_unused()
        for batch in run(batches):
            yield batch
            del batch
        pool.release_unused()

    return tidy


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text (runs of characters that are not ASCII white space); none for null."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE + "+")
    )
