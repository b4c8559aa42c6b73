"""Streams over append-only event logs. Spark features around W11 and E5; the batch forms are in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_windows(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """W11 by event time: counts by source in tumbling windows; later events than the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def ready(states: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """E5: checkpoints that are complete, pass every audit and are not evaluated yet."""
    sound = states.where(F.col("complete") & F.forall("audits", lambda a: a))
    return sound.join(done.select(key), key, "left_anti")
