"""Streams of archives, progress and published batches; keyed state is in keyed.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives as they appear below path; with a checkpoint each is seen once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)
    return files.select(F.col("path").alias("archive"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def progress(events: DataFrame, key: str = "session") -> DataFrame:
    """Running counts by key and type, for output mode update."""
    return events.groupBy(key, "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def publish(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", finish: bool = False):
    """Start a query that hands each batch to send; batches come again after a failure, with the same number.

    finish: take what is there now and stop, instead of waiting for more. Queries with processing-time timeouts never
    stop by themselves.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(send)
    return (writer.trigger(availableNow=True) if finish else writer).start()
