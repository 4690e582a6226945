"""Numbers for rows in a global order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from attesta.tables import written


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """The rows with their place in the order, from 1; rows that are alike in it are in any order.

    Rows are dealt out by ranges of the order and sorted there; what a range starts with is the sum of the ranges before it,
    of which there is one row each. Columns of the name ``name`` are replaced; null comes first.
    """
    # the place in the input is the last key, so that rows alike in the order are dealt to many tasks
    keys = [*order, "_at"]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.drop("_at").withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    dealt = written(dealt, "numbered")
    ranges = dealt.groupBy("_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    out = dealt.join(F.broadcast(ranges), "_part")  # a row for each task of one stage
    return out.withColumn(name, F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")
