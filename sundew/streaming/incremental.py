"""Incremental scanning with Structured Streaming: new files in, findings out, late rows and repeats handled by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sundew.operators import detect


def files_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def findings_stream(files: DataFrame, id_column: str, path_column: str, text_column: str) -> DataFrame:
    """The pattern detector over a stream of files; stateless."""
    return detect.detect(files, id_column, path_column, text_column).drop("lines", "at")


def first_sightings(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key once; repeats are dropped as long as the watermark lets the state live."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, keys: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, stop, keys, n): events per window and key; state is bounded by the watermark."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, "n")


def append_to(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream's rows as parquet, exactly once by the checkpoint; ``once`` stops when all present input is read."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
