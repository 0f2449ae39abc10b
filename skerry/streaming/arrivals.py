"""The collection cycle as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.tree import merge_days


def merge_arrivals(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], time: str, unique: Sequence[str]) -> StreamingQuery:
    """Merges what has arrived into the table at path, then stops. A later batch wins; a batch that runs twice changes nothing."""
    def merge(batch: DataFrame, number: int) -> None:
        merge_days(batch.withColumn("batch", F.lit(number)), path, keys, time, unique, "batch")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_hours(stream: DataFrame, keys: Sequence[str], time: str, value: str, expected: int, late: str = "2 hours") -> DataFrame:
    """(keys, hour, total): hours with exactly the expected number of readings, once the watermark has passed them. time is a timestamp."""
    hour = stream.withWatermark(time, late).groupBy(*keys, F.window(time, "1 hour").alias("w"))
    return hour.agg(F.sum(value).alias("total"), F.count(value).alias("n")).where(F.col("n") == expected).select(*keys, F.col("w.start").alias("hour"), "total")
