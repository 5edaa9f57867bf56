"""Streaming twins of the event-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trending(views: DataFrame, key: str, at: str, window: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Views of each key in sliding windows, for a stream or a table; late events past the watermark are dropped by a stream."""
    if views.isStreaming:
        views = views.withWatermark(at, late)
    counted = views.groupBy(F.window(at, window, slide).alias("w"), key).agg(F.count("*").alias("views"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "views")


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there to Parquet and stop; a later call takes up where this one ended."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).parquet(path)
