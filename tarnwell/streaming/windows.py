"""Streams: the trend component over windows with late data, and frozen cleaning of each micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(stream: DataFrame, time: str, metric: str, width: str = "1 hour", late: str = "1 hour", *by: str) -> DataFrame:
    """Means, sums and counts by tumbling window; rows later than late are dropped by the watermark."""
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    made = marked.groupBy(F.window(time, width), *by).agg(F.avg(metric).alias("mean"), F.sum(metric).alias("total"), F.count("*").alias("n"))
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "mean", "total", "n")


def sessions(stream: DataFrame, time: str, entity: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    made = marked.groupBy(F.session_window(time, gap), entity).agg(F.count("*").alias("n"))
    return made.select(entity, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def cleaned(stream: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """A frozen cleaning plan, as Columns that need no facts."""
    return stream.withColumns(changes)


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What there is now, in micro-batches, appended as Parquet exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
