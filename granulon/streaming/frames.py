"""Streams of frames and stage logs; additions beyond batch work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def frame_stream(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """New Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def stage_averages(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean and count by event-time window; rows later than the watermark are dropped by the state store."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "mean", "n")
