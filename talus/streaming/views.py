"""Structured Streaming forms of the stateful event logic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.sources.tables import KeyedTable


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def first_views(events: DataFrame, card: str, viewer: str, at: str, late: str) -> DataFrame:
    """Each (card, viewer) once within the watermark: exactly-once view counting."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([card, viewer])


def windowed_counts(events: DataFrame, at: str, by: str, length: str, late: str) -> DataFrame:
    """An addition of this library: event counts per tumbling window with late data up to the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), by).agg(F.count("*").alias("n"))


def latest_sink(spark: SparkSession, path: str, keys: list[str], newest: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that keeps the newest row per key in a bucketed table; replayed batches change nothing."""
    return KeyedTable(spark, path, keys, newest, buckets).sink()
