"""Writes as functions from tables to tables: upserts, guarded updates, deletes, merges of entities.

Nothing is changed in place. Each function returns the table's next state; write it where the old one was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.schemas import RECORDING_STATUSES, STAGES


def checked(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """The same rows; reading one with another value fails."""
    bad = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column)))
    return df.withColumn(column, F.when(F.col(column).isin(*values), F.col(column)).otherwise(bad))


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``updates`` replace those of ``base`` with equal keys; keys are unique on each side."""
    return base.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates)


def update_columns(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of ``updates`` that aren't null replace those of ``base``; no row is added."""
    new = [c for c in updates.columns if c not in keys]
    joined = base.join(updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new]), list(keys), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in base.columns])


def delete(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone.select(*keys), list(keys), "left_anti")


def insert_if_absent(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.unionByName(rows.join(base.select(*keys), list(keys), "left_anti"))


def compare_and_set(recordings: DataFrame, new_status: str, current: Sequence[str], *, only: DataFrame | None = None, unless: DataFrame | None = None) -> DataFrame:
    """Recordings with one of the current states get the new one; ``changed`` tells which.

    ``only`` and ``unless`` have recording ids (column id) that must, or must not, be there. A
    state that needs no review clears the review reason, if there is one.
    """
    if new_status not in RECORDING_STATUSES:
        raise ValueError(f"unknown status {new_status}")
    rows, guard = recordings, F.col("status").isin(*current)
    for name, side, want in (("_only", only, True), ("_unless", unless, False)):
        if side is not None:
            rows = rows.join(side.select("id").distinct().withColumn(name, F.lit(True)), "id", "left")
            guard = guard & (F.col(name).isNotNull() if want else F.col(name).isNull())
    out = rows.withColumn("changed", guard).withColumn("status", F.when(guard, new_status).otherwise(F.col("status")))
    if "review_reason_code" in out.columns and new_status != "NeedsReview":
        out = out.withColumn("review_reason_code", F.when(~F.col("changed"), F.col("review_reason_code")))
    return out.drop("_only", "_unless")


#: The state that each job command sets, and the states it must find; None for any.
JOB_MOVES = {
    "start": ("started", ("queued",)),
    "requeue": ("queued", None),
    "requeue_if_started": ("queued", ("started",)),
    "finish": ("finished", None),
    "finish_if_queued": ("finished", ("queued",)),
    "finish_if_started": ("finished", ("started",)),
    "fail": ("failed", None),
    "fail_if_queued": ("failed", ("queued",)),
    "fail_if_started": ("failed", ("started",)),
}


def apply_job_commands(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """Jobs after one command each (id, command, and if wanted at, error): those not allowed from a job's state do nothing.

    A start counts an attempt, sets the start and clears error and end; a requeue clears both times and writes its error;
    the others write their error and the end. Only columns that jobs have are written.
    """
    given = [c for c in ("at", "error") if c in commands.columns]
    rows = jobs.join(commands.select("id", "command", *[F.col(c).alias(f"_{c}") for c in given]), "id", "left")
    moved, status = F.lit(False), F.col("status")
    for name, (after, found) in JOB_MOVES.items():
        ok = (F.col("command") == name) & (F.col("status").isin(*found) if found else F.col("status").isNotNull())
        moved, status = moved | F.coalesce(ok, F.lit(False)), F.when(ok, after).otherwise(status)
    rows = rows.withColumn("moved", moved).withColumn("_after", status)
    at, error = (F.col(f"_{c}") if c in given else F.lit(None) for c in ("at", "error"))
    starts, requeues = F.col("_after") == "started", F.col("_after") == "queued"
    new = {
        "attempt": lambda c: c + F.when(starts, 1).otherwise(0),
        "error": lambda c: F.when(~starts, error),
        "started_at": lambda c: F.when(starts, at).when(~requeues, c),
        "finished_at": lambda c: F.when(~starts & ~requeues, at),
        "updated_at": lambda c: F.coalesce(at, c),
    }
    for name, value in new.items():
        if name in jobs.columns:
            kind = jobs.schema[name].dataType
            rows = rows.withColumn(name, F.when(F.col("moved"), value(F.col(name)).cast(kind)).otherwise(F.col(name)))
    return rows.withColumn("status", F.col("_after")).drop("command", "_after", *[f"_{c}" for c in given])


def stage_transitions(states: DataFrame, marks: DataFrame) -> DataFrame:
    """Stage rows (recording_id, stage_name) after marks (…, status, at): a start counts an attempt and clears the end; an end keeps the start."""
    new = marks.select("recording_id", "stage_name", F.col("status").alias("_status"), F.col("at").alias("_at"))
    rows = states.join(new, ["recording_id", "stage_name"], "full_outer")
    marked, starts = F.col("_status").isNotNull(), F.col("_status") == "running"
    started = F.when(starts, F.col("_at")).when(marked, F.coalesce("started_at", "_at")).otherwise(F.col("started_at"))
    finished = F.when(starts, F.lit(None)).when(marked, F.col("_at")).otherwise(F.col("finished_at"))
    attempt = F.coalesce("attempt", F.lit(0)) + F.when(starts, 1).otherwise(0)
    out = rows.select("recording_id", "stage_name", F.coalesce("_status", "status").alias("status"), F.when(marked & ~starts, F.greatest(attempt, F.lit(1))).otherwise(attempt).alias("attempt"), started.alias("started_at"), finished.alias("finished_at"))
    spent = F.expr("timestampdiff(MILLISECOND, started_at, finished_at)")
    return out.withColumn("duration_ms", F.when(F.col("finished_at").isNotNull(), F.greatest(F.lit(0), spent)))


def clear_stages(states: DataFrame, from_stage: str) -> DataFrame:
    """Stage rows before a stage."""
    order = {name: k for name, k, *_ in STAGES}
    if from_stage not in order:
        raise ValueError(f"unknown stage {from_stage}")
    before = [name for name, k in order.items() if k < order[from_stage]]
    return states.where(F.col("stage_name").isin(*before) if before else F.lit(False))


def replace_window(base: DataFrame, events: DataFrame, low: int, high: int, *, source_id: int) -> DataFrame:
    """Calendar events of a source after a sync: those that overlap the window go, and the new ones come; a key counts once."""
    gone = (F.col("source_id") == source_id) & (F.col("starts_ms") < high) & (F.col("ends_ms") > low)
    kept = base.where(~gone)
    return upsert(kept, events, ["source_id", "event_id", "starts_ms"])


def accumulate(base: DataFrame, deltas: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sums of old values and changes; keys whose changes are all zero aren't added."""
    return base.select(*keys, value).unionByName(deltas.where(F.col(value) != 0).select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def merge_entities(rows: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """Rows with ids re-pointed by (source, target)."""
    pairs = merged.select(F.col("source").alias(column), F.col("target").alias("_target"))
    return rows.join(pairs, column, "left").withColumn(column, F.coalesce("_target", column)).drop("_target").select(rows.columns)


def rewritten_ids(ids: Column, source: int, target: int) -> Column:
    """A sorted array of ids with one replaced, each once."""
    return F.array_sort(F.array_distinct(F.transform(ids, lambda x: F.when(x == source, F.lit(target)).otherwise(x))))


def rewritten_candidates(candidates: Column, source: int, target: int) -> Column:
    """Candidate matches with one profile replaced; the best score of a profile stays, best first."""
    moved = F.transform(candidates, lambda c: F.struct((-c["score"]).alias("rank"), F.when(c["voice_profile_id"] == source, F.lit(target)).otherwise(c["voice_profile_id"]).alias("id")))
    ordered = F.array_sort(moved)
    empty = F.array().cast("array<struct<rank: double, id: bigint>>")
    once = F.aggregate(ordered, empty, lambda out, c: F.when(F.exists(out, lambda o: o["id"] == c["id"]), out).otherwise(F.array_append(out, F.struct(c["rank"].cast("double").alias("rank"), c["id"].cast("bigint").alias("id")))))
    return F.transform(once, lambda c: F.struct(c["id"].alias("voice_profile_id"), (-c["rank"]).alias("score")))


