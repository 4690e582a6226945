"""A ledger of events that grows: each content once, appended by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.functions import text as tx


def entries(events: DataFrame, kind: str, operation: str, payload: str, at: str, late: str = "1 hour") -> DataFrame:
    """The events with entry_id, of one content the first only, as long as it comes within ``late`` of its like.

    State is what the watermark keeps, so that it doesn't grow with the ledger.
    """
    keyed = events.withColumn("entry_id", tx.stable_id_of("EVT", F.col(kind), F.col(operation), F.col(payload), digits=20))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["entry_id"])


def append(ledger: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the entries that have come to a folder of Parquet files, exactly once, and stop; both folders are shared ones."""
    return ledger.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
