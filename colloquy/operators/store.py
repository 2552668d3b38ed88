"""Read models over recordings, jobs, projects and calendars: filters, joins, counts, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.schemas import JOB_STATUSES, RECORDING_STATUSES

MAX_PAGE = 500


def page(df: DataFrame, order: Sequence[Column | str], *, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a unique order; limits are held to 1..500 and offsets to 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), MAX_PAGE))


def page_links(total: int, *, limit: int = 50, offset: int = 0) -> dict:
    """Where the pages before and after begin."""
    limit, offset = min(max(1, limit), MAX_PAGE), max(0, offset)
    return {"total": total, "limit": limit, "offset": offset, "has_prev": offset > 0, "has_next": offset + limit < total, "prev_offset": max(0, offset - limit), "next_offset": offset + limit}


def search(recordings: DataFrame, *, status: str | None = None, q: str | None = None, columns: Sequence[str] = ("id", "source_filename")) -> DataFrame:
    """Recordings of a status whose id or file name holds a text, whatever its case."""
    rows = recordings
    if status is not None:
        if status not in RECORDING_STATUSES:
            raise ValueError(f"unknown status {status}")
        rows = rows.where(F.col("status") == status)
    if q and q.strip():
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.lower(F.col(c).cast("string")).contains(q.strip().lower())
        rows = rows.where(hit)
    return rows


def with_projects(recordings: DataFrame, projects: DataFrame, *, suggested: str | None = None) -> DataFrame:
    """Names of a recording's project, and of the one suggested for it. Spark broadcasts projects if they are small."""
    out = recordings.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")
    if suggested:
        out = out.join(projects.select(F.col("id").alias(suggested), F.col("name").alias("suggested_project_name")), suggested, "left")
    return out


def zero_filled_counts(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows of each of the fixed values, zero included; other values aren't counted."""
    spark = df.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def recording_counts(recordings: DataFrame) -> DataFrame:
    return zero_filled_counts(recordings, "status", RECORDING_STATUSES)


def job_counts(jobs: DataFrame) -> DataFrame:
    return zero_filled_counts(jobs, "status", JOB_STATUSES)


def stale_started_jobs(jobs: DataFrame, recordings: DataFrame, before: Column) -> DataFrame:
    """Started jobs from before a time, with their recordings' states."""
    old = jobs.where((F.col("status") == "started") & F.col("started_at").isNotNull() & (F.col("started_at") < before))
    return old.join(recordings.select(F.col("id").alias("recording_id"), F.col("status").alias("recording_status")), "recording_id")


def without_started_job(recordings: DataFrame, jobs: DataFrame, statuses: Sequence[str]) -> DataFrame:
    started = jobs.where("status = 'started'").select(F.col("recording_id").alias("id"))
    return recordings.where(F.col("status").isin(*statuses)).join(started, "id", "left_anti")


def active_job(jobs: DataFrame) -> DataFrame:
    """Each recording's active job: started before queued, then the last updated, the last created, the highest id."""
    key = F.struct(F.when(F.col("status") == "started", 1).otherwise(0), "updated_at", "created_at", "id")
    return jobs.where(F.col("status").isin("started", "queued")).groupBy("recording_id").agg(F.max_by(F.struct("id", "type", "status"), key).alias("job")).select("recording_id", "job.*")


def events_in_window(events: DataFrame, low: int, high: int, *, source_id: int | None = None) -> DataFrame:
    """Calendar events that overlap a window."""
    rows = events.where((F.col("starts_ms") < high) & (F.col("ends_ms") > low))
    return rows if source_id is None else rows.where(F.col("source_id") == source_id)


def expired(recordings: DataFrame, cutoff: Column, *, status: str = "Quarantine") -> DataFrame:
    """Recordings of a status last touched by a cutoff."""
    return recordings.where((F.col("status") == status) & (F.coalesce("updated_at", "created_at") <= cutoff))


def same_content(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with equal content, by length and SHA-256: each with the least key and the number of its copies."""
    rows = docs.select(F.col(key), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("size"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"))
    groups = rows.groupBy("size", "sha256").agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))
    return rows.join(groups, ["size", "sha256"])


def top_samples(samples: DataFrame, k: int = 3) -> DataFrame:
    """The newest ``k`` samples of each profile, and whether it has more. Spark limits each partition's groups before the shuffle."""
    known = samples.where("voice_profile_id IS NOT NULL")
    w = Window.partitionBy("voice_profile_id").orderBy(F.desc("sample_id"))
    top = known.select("voice_profile_id", "sample_id", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    sizes = known.groupBy("voice_profile_id").agg(F.count("*").alias("n"))
    return top.join(sizes, "voice_profile_id").select("voice_profile_id", "sample_id", F.col("rank").cast("long").alias("rank"), (F.col("n") > k).alias("has_more"))
