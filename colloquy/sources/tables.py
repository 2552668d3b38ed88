"""The given tables, and views of them in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def millis(ts: str) -> Column:
    """Milliseconds of a zoneless timestamp column, cut off; the session's zone has no part in it."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts}) div 1000")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as timed segments: a recording is a day, a speaker one of five, the value a length in seconds."""
    start = millis("ts")
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("recording_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("speaker"),
        start.alias("start_ms"),
        (start + F.round(F.col("value") * 1000).cast("long")).alias("end_ms"),
        F.col("event_type").alias("text"),
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as turns of 60 ms a character, one after the other."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    length = F.length(F.coalesce("text", F.lit(""))).cast("long") * 60
    end = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = table(spark, sf_dir, "conversations").withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - length)
    return rows.select(F.col("conv_id").cast("string").alias("recording_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "start_ms", "end_ms", "text")


def asr_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as recognised speech: a segment every five seconds, a word every 400 ms, so that long ones run into the next."""
    at = F.col("turn") * 5000
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    timed = F.transform(words, lambda w, k: F.struct((at + k * 400).alias("start_ms"), (at + k * 400 + 350).alias("end_ms"), w.alias("word")))
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("recording_id"), F.col("turn").alias("seq"), at.alias("start_ms"), (at + F.size(words) * 400).alias("end_ms"), "text", timed.alias("words"), F.lit(None).cast("string").alias("language"))


def role_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as diarization: each turn's role speaks for 3.3 of its five seconds."""
    at = F.col("turn") * 5000
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("recording_id"), F.col("turn").alias("seq"), F.coalesce("role", F.lit("S1")).alias("speaker"), (at + 700).alias("start_ms"), (at + 4000).alias("end_ms"), "text")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as jobs of customers' recordings, updated up to 40 days after they were made."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "started").when(F.col("o_orderstatus") == "F", "finished")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("recording_id"),
        F.col("o_orderpriority").alias("type"),
        status.alias("status"),
        F.col("o_orderdate").alias("started_at"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 41).cast("int"))).alias("updated_at"),
    )


#: Which state a market segment stands for.
SEGMENT_STATUS = {"AUTOMOBILE": "Queued", "BUILDING": "Processing", "FURNITURE": "NeedsReview", "HOUSEHOLD": "Ready", "MACHINERY": "Quarantine"}


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as recordings, nations as their projects."""
    status = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in SEGMENT_STATUS.items()], F.lit("Failed"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("source_filename"),
        status.alias("status"),
        F.col("c_nationkey").cast("long").alias("project_id"),
        F.col("c_acctbal").alias("duration_sec"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as calendar events of 20 seconds for each unit of value."""
    start = millis("ts")
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return rows.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        (F.col("user_id") % 4).alias("source_id"),
        start.alias("starts_ms"),
        (start + F.round(F.col("value") * 20000).cast("long")).alias("ends_ms"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as recordings with a capture time and a duration in seconds."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.select(F.col("event_id").alias("recording_id"), millis("ts").alias("captured_ms"), F.col("value").alias("duration_sec"))


def keyword_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as weight changes in cents of a project's keywords."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("project_id"),
        F.concat_ws(":", "event_type", (k % 20).cast("string")).alias("keyword"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.col("event_id").alias("seq"),
    )


def voice_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as voice samples of profiles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("long").alias("voice_profile_id"), F.col("embedding").cast("array<double>").alias("embedding"))
