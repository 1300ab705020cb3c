"""Windows over an event stream: the same aggregations for a table and for a stream with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def tumbling(events: DataFrame, width: str = "1 hour", places: int = 4) -> DataFrame:
    found = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), places).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    found = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", places: int = 4) -> DataFrame:
    found = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), places).alias("total"))
    return found.select("user_id", F.col("w.start").alias("session_start"), "n", "total")


def drained(frame: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result table."""
    name = f"s_{uuid.uuid4().hex}"
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


def stream_tumbling(spark: SparkSession, sf_dir: str, delay: str = "2 hours") -> DataFrame:
    """tumbling() over the events read as a stream, with a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").withWatermark("ts", delay)
    return drained(tumbling(stream))
