"""Columns that were added later, filled from related rows, and placeholder rows that go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The time of rows that nothing dates, and the kinds of jobs that were made as placeholders.
NEVER = "1970-01-01 00:00:00"
PLACEHOLDERS = ("stt", "diarize", "align", "language", "llm", "metrics")


def dated_profiles(profiles: DataFrame, samples: DataFrame) -> DataFrame:
    """Profiles (id, created_at, updated_at) with a missing creation taken from their first sample, and a missing update from the creation."""
    first = samples.groupBy(F.col("voice_profile_id").alias("id")).agg(F.min("created_at").alias("_first"))
    rows = profiles.join(first, "id", "left")
    kind = profiles.schema["created_at"].dataType
    created = F.coalesce("created_at", "_first", F.lit(NEVER).cast(kind))
    return rows.withColumn("created_at", created).withColumn("updated_at", F.coalesce("updated_at", "created_at")).drop("_first")


def dated_assignments(assignments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Assignments with ``updated_at`` of their recording."""
    known = recordings.select(F.col("id").alias("recording_id"), "updated_at")
    kind = recordings.schema["updated_at"].dataType
    return assignments.join(known, "recording_id", "left").withColumn("updated_at", F.coalesce("updated_at", F.lit(NEVER).cast(kind)))


def without_placeholders(jobs: DataFrame, recordings: DataFrame, *, seconds: float = 30.0, types: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """Jobs without those of some types that were queued within ``seconds`` after their recording was made and never began."""
    made = recordings.select(F.col("id").alias("recording_id"), F.col("created_at").alias("_made"))
    rows = jobs.join(made, "recording_id", "left")
    later = F.expr("timestampdiff(MICROSECOND, _made, created_at)") / 1e6
    idle = F.col("type").isin(*types) & (F.col("status") == "queued") & F.col("started_at").isNull() & F.col("finished_at").isNull()
    return rows.where(~F.coalesce(idle & later.between(0.0, seconds), F.lit(False))).select(jobs.columns)
