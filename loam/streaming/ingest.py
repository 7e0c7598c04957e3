"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unseen(stream: DataFrame, text: str = "text", at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose text hash wasn't seen before (within the watermark, if there is an event time)."""
    hashed = stream.withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    if at is None:
        return hashed.dropDuplicates(["text_hash"])
    return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["text_hash"])


def ingest(stream: DataFrame, path: str, checkpoint: str, text: str = "text"):
    """Starts a query that appends unseen rows to a Parquet folder and stops when the input is used up."""
    return unseen(stream, text).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
