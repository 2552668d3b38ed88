"""Structured Streaming forms of the polling loops, with the same functions for batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str, *, delay: str = "1 hour") -> DataFrame:
    """``events`` as a stream with a watermark; run it with an available-now trigger to end it."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def event_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def activity_sessions(events: DataFrame, *, gap: str = "2 hours") -> DataFrame:
    """Each user's stretches of activity; one whose end has passed without an event is a job that got stuck."""
    w = F.session_window("ts", gap)
    return events.groupBy("user_id", w).agg(F.count("*").alias("events"), F.max("ts").alias("last_ts")).select("user_id", F.col("session_window.start").alias("first_ts"), "last_ts", "events")


def stale_sessions(events: DataFrame, *, gap: str = "2 hours") -> DataFrame:
    """As ``activity_sessions``, with only those that began and never went on."""
    return activity_sessions(events, gap=gap).where("events = 1")


def tumbling_ratio(events: DataFrame, *, length: str = "1 hour", least: float = 30.0) -> DataFrame:
    """How many events of each window of time reach a value, as frames with speech do."""
    loud = F.count_if(F.col("value") >= least)
    rows = events.groupBy(F.window("ts", length).alias("w")).agg(F.count("*").alias("frames"), loud.alias("loud"))
    return rows.select(F.col("w.start").alias("start_ts"), "frames", "loud")


def once_per_attempt(commands: DataFrame) -> DataFrame:
    """Commands of a stream (job_id, attempt, ts with watermark), each job's attempt once."""
    return commands.dropDuplicatesWithinWatermark(["job_id", "attempt"])
