"""Change feed and windowed aggregates as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_feed(spark: SparkSession, path: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Calls ``each(batch, batch_id)`` with the rows of new files in ``path``; ``checkpoint`` remembers what was seen.

    ``once`` handles what is there and stops; otherwise the query keeps running.
    """
    writer = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(events: DataFrame, time: str, size: str, late: str, keys: list[str], **aggs) -> DataFrame:
    """Aggregates by key in windows of ``size``; rows later than ``late`` are dropped (streams)."""
    marked = events.withColumn(time, F.col(time).cast("timestamp"))
    marked = marked.withWatermark(time, late) if events.isStreaming else marked
    return marked.groupBy(F.window(time, size).alias("window"), *keys).agg(*[v.alias(k) for k, v in aggs.items()])


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str], **aggs) -> DataFrame:
    """Aggregates by key in sessions that end after ``gap`` without events."""
    marked = events.withColumn(time, F.col(time).cast("timestamp"))
    marked = marked.withWatermark(time, late) if events.isStreaming else marked
    return marked.groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*[v.alias(k) for k, v in aggs.items()])
