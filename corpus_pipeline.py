"""A corpus pipeline: language, near duplicates, secrets, mixture, tokens. Each stage is one operator of attesta.llm.

A stage takes (spark, docs, sf_dir) and returns rows that are written as Parquet and read again as the next stage's docs. All
but the last return the columns of ``documents``: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm import byte_bpe, language_id, mixing, secret_scan, shingle_links
from attesta.llm.common import new_dir, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language matches less than this is none of the languages learned.
LEAST_LANGUAGE_SCORE = 0.2
REDACTED = "[REDACTED]"
#: Bytes of texts that go to a Python worker at a time; stages set this for the session, whose default has no bound.
BATCH_BYTES = "8m"


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; those without a letter, or unlike every language learned, go.

    ``lang`` becomes the predicted language. Null and empty texts have none and go. Rows with one doc_id and text share a
    prediction.
    """
    _bounded(spark)
    profiles = language_id.learn(docs)
    return language_id.labelled(docs.select(COLUMNS), profiles, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id (null ids last); none is lost.

    Near duplicates share four fifths of their five-word shingles, exactly measured, or are linked by such documents. Ids may
    be null or repeated: unlike texts are in groups of their own whatever their ids. Null and empty texts are one group.
    """
    _bounded(spark)
    return shingle_links.one_of_each(docs.select(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret in its text replaced; n_chars follows the text."""
    _bounded(spark)
    found = secret_scan.scan(docs, keep=tuple(COLUMNS))
    text = F.when(F.size("spans") > 0, secret_scan.redacted(F.col("text"), F.col("spans"), REDACTED)).otherwise(F.col("text"))
    n_chars = F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": n_chars}).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that the mix takes some of a document, with the words taken.

    Null and empty texts stay as they are; rows with one doc_id are documents of their own, and a null source is one source.
    """
    _bounded(spark)
    return mixing.remixed(docs, COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (binary, little-endian unsigned 32-bit) and the hash of what they decode to, of every row.

    A null text counts as empty; repeated rows give a row each.
    """
    _bounded(spark)
    return byte_bpe.encode(docs).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: Learning profiles, merging trees and encoding are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_dir(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
