"""Property graphs as two tables, lineage ledgers as three, and checks of references. Hops are joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from attesta.functions import text as tx


def nodes(*parts: DataFrame) -> DataFrame:
    """node_id, node_type, label of all parts; of one id, the smallest type and label, so that order doesn't matter."""
    rows = reduce(DataFrame.unionByName, [p.select("node_id", "node_type", "label") for p in parts])
    return rows.groupBy("node_id").agg(F.min(F.struct("node_type", "label")).alias("x")).select("node_id", "x.node_type", "x.label")


def edges(*parts: DataFrame) -> DataFrame:
    """edge_id, source, target, edge_type, each edge once.

    Edges are dealt out by their source, so that a join on it, or a count of it, needs no shuffle of its own.
    """
    rows = reduce(DataFrame.unionByName, [p.select("source", "target", "edge_type") for p in parts])
    return rows.repartition("source").distinct().withColumn("edge_id", edge_id(F.col("source"), F.col("target"), F.col("edge_type")))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return tx.stable_id_of("EDGE", source, target, kind)


def add_edges(found: DataFrame, known: DataFrame) -> DataFrame:
    """The edges both of whose ends are known nodes."""
    ids = known.select("node_id")
    kept = found.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
    return kept.join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def remove_nodes(known: DataFrame, found: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone`` (node_id), and edges without those that touch them."""
    kept = known.join(gone, "node_id", "left_anti")
    e = found.join(gone.withColumnRenamed("node_id", "source"), "source", "left_anti")
    return kept, e.join(gone.withColumnRenamed("node_id", "target"), "target", "left_anti")


def neighbors(found: DataFrame, node_id: str) -> DataFrame:
    out = found.where(F.col("source") == node_id).select(F.col("target").alias("node_id"))
    return out.union(found.where(F.col("target") == node_id).select("source")).distinct()


def type_statistics(known: DataFrame, found: DataFrame) -> DataFrame:
    n = known.groupBy(F.lit("node").alias("part"), F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(found.groupBy(F.lit("edge").alias("part"), F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


def two_hops(found: DataFrame, first: str, second: str) -> DataFrame:
    """start, via and end of paths of an edge of type ``first`` and one of type ``second``."""
    a = found.where(F.col("edge_type") == first).select(F.col("source").alias("start"), F.col("target").alias("via"))
    b = found.where(F.col("edge_type") == second).select(F.col("source").alias("via"), F.col("target").alias("end"))
    return a.join(b, "via")


def dangling(found: DataFrame, known: DataFrame) -> DataFrame:
    """edge_id, end and missing: ends that are no known node."""
    ids = known.select("node_id")
    sides = [found.join(ids, F.col(c) == F.col("node_id"), "left_anti").select("edge_id", F.lit(c).alias("end"), F.col(c).alias("missing")) for c in ("source", "target")]
    return sides[0].unionByName(sides[1])


# checks -------------------------------------------------------------------------------------------------------------


def duplicates(rows: DataFrame, key: Column, code: str) -> DataFrame:
    """code, value and n of keys that stand more than once."""
    return rows.groupBy(key.cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(code).alias("code"), "value", "n")


def missing_references(rows: DataFrame, key: Column, known: DataFrame, known_key: Column, code: str) -> DataFrame:
    """code, value and n of keys that ``known`` doesn't have."""
    ids = known.select(known_key.alias("_known")).distinct()
    gone = rows.select(key.alias("_key")).where(F.col("_key").isNotNull()).join(ids, F.col("_key") == F.col("_known"), "left_anti")
    return gone.groupBy(F.col("_key").cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "value", "n")


def out_of_range(rows: DataFrame, keys: list[str], columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The keys, field and value of numbers that are null, not finite or outside the range."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")
    x = rows.select(*keys, fields).select(*keys, "x.field", "x.value")
    return x.where(F.col("value").isNull() | F.isnan("value") | (F.col("value") < low) | (F.col("value") > high))


# ledgers ------------------------------------------------------------------------------------------------------------


def ledger_entries(events: DataFrame, kind: str, operation: str, payload: str, order: str) -> DataFrame:
    """Entries of a ledger, each content once: entry_id from kind, operation and payload; the first in order, and how many."""
    keyed = events.withColumn("entry_id", tx.stable_id_of("EVT", F.col(kind), F.col(operation), F.col(payload), digits=20))
    return keyed.groupBy("entry_id").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.min_by(kind, order).alias(kind))


def lineage(artifacts: DataFrame, id_col: str, parents_col: str) -> DataFrame:
    """Each artifact's parents, one hop: artifact, parent and whether the parent is there."""
    pairs = artifacts.select(F.col(id_col).alias("artifact"), F.explode(parents_col).alias("parent"))
    known = artifacts.select(F.col(id_col).alias("parent")).distinct().withColumn("known", F.lit(True))
    return pairs.join(known, "parent", "left").select("artifact", "parent", F.coalesce("known", F.lit(False)).alias("known"))


def manifest_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A hash of a table that doesn't depend on the order of its rows: of the sum of its rows' hashes, and their number."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    total = rows.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(20,0)")).alias("s"))
    return total.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("0"))).cast("binary"), 256).alias("manifest"))
