"""The same event logic over streams: windowed counts with watermarks, duplicates dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(like.schema).parquet(folder)


def windowed(events: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts for each tumbling window and key set, late events admitted up to `late`."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], ttl: str) -> DataFrame:
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and give its result as a table in memory; for bounded sources."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
