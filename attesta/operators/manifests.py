"""Manifests of tables that can be verified in part: rows in chunks by a hash of their key, chunks in a tree of digests.

A chunk's digest depends on the rows that belong there and on nothing else, so that a row that is altered, missing or new
changes its chunk and what lies above it only, wherever rows stand in files. Verifying compares chunks, and then the rows of
chunks that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Chunks by default, and how many of a level make one of the level above; powers of 16.
CHUNKS = 4096
FANOUT = 16


def framed(column: Column) -> Column:
    """A field as part of a row's digest: ``-`` for null, else its count of UTF-8 bytes, a colon and the value as text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digests(rows: DataFrame, keys: list[str], columns: list[str], chunks: int = CHUNKS) -> DataFrame:
    """chunk, the keys, digest of the columns and n (rows alike in both) of all rows."""
    digits = len(f"{chunks - 1:x}")
    key = F.sha2(F.concat(*[framed(F.col(k)) for k in keys]), 256)
    chunk = F.conv(F.substring(key, 1, digits), 16, 10).cast("int") % chunks
    digest = F.sha2(F.concat(*[framed(F.col(c)) for c in columns]), 256)
    each = rows.select(chunk.alias("chunk"), *keys, digest.alias("digest"))
    return each.groupBy("chunk", *keys, "digest").agg(F.count("*").alias("n"))


def _folded(rows: DataFrame, part: Column) -> DataFrame:
    """n and digest of each chunk: of its parts in order."""
    joined = F.concat_ws("", F.array_sort(F.collect_list("part")))
    return rows.select("chunk", part.alias("part"), "n").groupBy("chunk").agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))


def manifest(rows: DataFrame, keys: list[str], columns: list[str], chunks: int = CHUNKS) -> DataFrame:
    """level (0: chunks of rows; the last: the whole table), chunk, n (rows) and digest; chunks without rows have none.

    A part of a chunk is a row's key, digest and number, told as framed fields, or a chunk of the level below with its number.
    """
    base = _folded(row_digests(rows, keys, columns, chunks), F.concat(*[framed(F.col(c)) for c in (*keys, "digest", "n")]))
    levels, size = [base.withColumn("level", F.lit(0))], chunks
    while size > 1:
        size = -(-size // FANOUT)
        below = levels[-1].select(F.expr(f"chunk div {FANOUT}").cast("int").alias("chunk"), "n", F.concat(F.lpad(F.col("chunk").cast("string"), 10, "0"), F.lit(":"), "digest").alias("p"))
        levels.append(_folded(below, F.col("p")).withColumn("level", F.lit(len(levels))))
    return reduce(DataFrame.unionByName, levels).select("level", "chunk", "n", "digest")


def differing(stored: DataFrame, now: DataFrame) -> DataFrame:
    """level, chunk, n_stored and n_now of the chunks of two manifests that differ; a chunk without rows has 0."""
    both = stored.toDF("level", "chunk", "n_stored", "a").join(now.toDF("level", "chunk", "n_now", "b"), ["level", "chunk"], "full_outer")
    changed = ~F.col("a").eqNullSafe(F.col("b"))
    return both.where(changed).select("level", "chunk", F.coalesce("n_stored", F.lit(0)).alias("n_stored"), F.coalesce("n_now", F.lit(0)).alias("n_now"))


def changed_rows(stored: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and change (missing, new, altered) of two tables of ``row_digests``. Only chunks that differ are compared row by
    row. A key that several unlike rows have is altered if their digests or numbers are not the same."""

    def chunk_sums(rows: DataFrame, name: str) -> DataFrame:
        return _folded(rows, F.concat(*[framed(F.col(c)) for c in (*keys, "digest", "n")])).select("chunk", F.col("digest").alias(name))

    sums = chunk_sums(stored, "a").join(chunk_sums(now, "b"), "chunk", "full_outer")
    wrong = sums.where(~F.col("a").eqNullSafe(F.col("b"))).select("chunk")

    def told(rows: DataFrame, name: str) -> DataFrame:
        part = F.array_sort(F.collect_list(F.concat_ws(":", "digest", F.col("n").cast("string"))))
        key = F.concat(*[framed(F.col(k)) for k in keys]).alias("_key")
        return rows.join(wrong, "chunk", "left_semi").groupBy(key, *keys).agg(part.alias(name))

    # keys may be null: their framed form meets
    a, b = told(stored, "a"), told(now, "b").withColumnsRenamed({k: f"_{k}" for k in keys})
    both = a.join(b, "_key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").otherwise("altered")
    return both.select(*[F.when(F.col("a").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys], change.alias("change"))
