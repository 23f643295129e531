"""Stateless rules and duplicate keys on streams. The reference workload is batch; these forms serve deliveries that trickle in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from stammwerk.operators import findings as fnd


def watch(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_rule(stream: DataFrame, condition: Column, facts: dict[str, str], keys: list[str]) -> DataFrame:
    """A rule of one table over a stream: rows that meet the condition, as findings; no state."""
    return fnd.as_findings(stream.filter(condition), facts, keys)


def first_of_key(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """The first row of each key within the delay; later ones are dropped, and so is the state beyond the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
