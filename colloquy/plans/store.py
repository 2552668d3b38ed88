"""Queries over recordings, jobs and calendars, and their next states after writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import changes, store
from colloquy.plans.sql import MS
from colloquy.sources.tables import SEGMENT_STATUS, calendar_events, jobs, keyword_weights, projects, recordings, table, voice_samples
from colloquy.streaming import reaper, sync

CUTOFF = "1999-01-01"


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recording_counts(recordings(spark, sf_dir))


def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.job_counts(jobs(spark, sf_dir))


def recordings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is the feature: the second hundred of one state, with project names."""
    rows = store.with_projects(store.search(recordings(spark, sf_dir), status="Ready"), projects(spark, sf_dir))
    return store.page(rows, [F.desc("duration_sec"), "id"], limit=100, offset=100).select("id", "source_filename", "status", "project_name", "duration_sec")


def recordings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.search(recordings(spark, sf_dir), q="R#0000001").select("id", "source_filename", "status")


def jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir).where("status = 'queued'")
    return store.page(rows, [F.desc("created_at"), F.desc("id")], limit=500).select("id", "recording_id", "type")


def stale_started_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.stale_started_jobs(jobs(spark, sf_dir), recordings(spark, sf_dir), F.to_timestamp_ntz(F.lit(CUTOFF)))
    return rows.select("id", "recording_id", "recording_status")


def recordings_without_started_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without_started_job(recordings(spark, sf_dir), jobs(spark, sf_dir), ["Processing", "Queued"]).select("id", "status")


def active_job_per_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.active_job(jobs(spark, sf_dir))


def event_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as calendar sources: most have no events."""
    events = calendar_events(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"))
    sources = projects(spark, sf_dir)
    return sources.join(events, sources["id"] == events["source_id"], "left").select(F.col("id").alias("source_id"), "name", F.coalesce("n", F.lit(0)).alias("events"))


def calendar_window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = 1704585600000, 1705190400000  # a week from 2024-01-07
    return store.events_in_window(calendar_events(spark, sf_dir), low, high)


def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.same_content(table(spark, sf_dir, "documents"))


def newest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.top_samples(voice_samples(spark, sf_dir))


def retention_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined recordings whose last job is old."""
    last = jobs(spark, sf_dir).groupBy(F.col("recording_id").alias("id")).agg(F.max("created_at").alias("updated_at"))
    rows = recordings(spark, sf_dir).join(last, "id", "left").withColumn("created_at", F.to_timestamp_ntz(F.lit("1990-01-01")))
    return store.expired(rows, F.to_timestamp_ntz(F.lit(CUTOFF))).select("id")


def status_cas_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing recordings without a started job go to review."""
    started = jobs(spark, sf_dir).where("status = 'started'").select(F.col("recording_id").alias("id"))
    return changes.compare_and_set(recordings(spark, sf_dir), "NeedsReview", ["Processing"], unless=started).select("id", "status", "changed")


def job_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for every job, by its id."""
    rows = jobs(spark, sf_dir).withColumns({"attempt": F.lit(1).cast("long"), "error": F.lit("old"), "finished_at": F.col("created_at")})
    command = F.element_at(F.array(*[F.lit(c) for c in changes.JOB_MOVES]), (F.col("id") % len(changes.JOB_MOVES)).cast("int") + 1)
    orders = rows.select("id", command.alias("command"), F.to_timestamp_ntz(F.lit("2000-01-01")).alias("at"), F.lit("new").alias("error"))
    return changes.apply_job_commands(rows, orders).select("id", "status", "attempt", "error", "started_at", "finished_at", "moved")


def reaper_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of the reaper does to the states of recordings, and how many jobs it fails for each."""
    done = jobs(spark, sf_dir)
    last = done.groupBy(F.col("recording_id").alias("id")).agg(F.min("updated_at").alias("updated_at"))
    rows = recordings(spark, sf_dir).join(last, "id").select("id", "status", "updated_at")
    reaped, after = reaper.reap(done, rows, F.to_timestamp_ntz(F.lit(CUTOFF)))
    failed = reaped.where("recovered").groupBy(F.col("recording_id").alias("id")).agg(F.count("*").alias("failed_jobs"))
    return after.join(failed, "id", "left").select("id", "status", "recovered", F.coalesce("failed_jobs", F.lit(0)).cast("long").alias("failed_jobs"))


def calendar_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three syncs of even sources over growing windows: what they find lies a minute later, and every third event is gone."""
    rows = calendar_events(spark, sf_dir)
    low, week = 1704585600000, 604800000
    asked = spark.range(1, 4).select(F.col("id").alias("sync_id"), F.lit(low).cast("long").alias("low_ms"), (F.lit(low) + F.col("id") * week).alias("high_ms"))
    asked = asked.join(rows.select("source_id").distinct().where("source_id % 2 = 0"))  # a few sources, three syncs
    seen = rows.where(F.substring("event_id", 2, 20).cast("long") % 3 > 0).withColumns({"starts_ms": F.col("starts_ms") + 60_000, "ends_ms": F.col("ends_ms") + 60_000})
    inside = (F.col("a.source_id") == F.col("s.source_id")) & (F.col("s.starts_ms") < F.col("a.high_ms")) & (F.col("s.ends_ms") > F.col("a.low_ms"))
    syncs = asked.alias("a").join(seen.alias("s"), inside, "left").select("a.sync_id", "a.source_id", "a.low_ms", "a.high_ms", "s.event_id", "s.starts_ms", "s.ends_ms")
    return sync.replaced(rows, syncs)


def stage_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued and finished jobs as stage states and marks."""
    rows = jobs(spark, sf_dir).groupBy("recording_id", "status").agg(F.max("created_at").alias("at"))
    states = rows.where("status = 'finished'").select("recording_id", F.lit("asr").alias("stage_name"), "status", F.lit(1).cast("long").alias("attempt"), F.col("at").alias("started_at"), F.col("at").alias("finished_at"))
    marks = rows.where("status = 'queued'").select("recording_id", F.lit("asr").alias("stage_name"), F.when(F.col("recording_id") % 2 == 0, "running").otherwise("completed").alias("status"), "at")
    return changes.stage_transitions(states, marks).select("recording_id", "status", F.col("attempt").cast("long").alias("attempt"), "duration_ms")


def calendar_replace_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source 1's events of a window give way to source 2's, moved by a minute."""
    rows = calendar_events(spark, sf_dir)
    low, high = 1704585600000, 1705190400000
    new = store.events_in_window(rows, low, high, source_id=2).withColumn("source_id", F.lit(1).cast("long"))
    new = new.withColumns({"starts_ms": F.col("starts_ms") + 60_000, "ends_ms": F.col("ends_ms") + 60_000})
    return changes.replace_window(rows, new, low, high, source_id=1)


def weights_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyword_weights(spark, sf_dir)
    old = rows.where("seq % 2 = 0").groupBy("project_id", "keyword").agg(F.sum("cents").alias("cents"))
    return changes.accumulate(old, rows.where("seq % 2 = 1"), ["project_id", "keyword"], "cents")


def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd profiles merge into the even ones before them: their samples follow."""
    samples = voice_samples(spark, sf_dir).select("sample_id", "voice_profile_id")
    merged = samples.select(F.col("voice_profile_id").alias("source")).distinct().where("source % 2 = 1").withColumn("target", F.col("source") - 1)
    return changes.merge_entities(samples, merged, "voice_profile_id").groupBy("voice_profile_id").agg(F.count("*").alias("samples"), F.min("sample_id").alias("first_sample"))


_STATUS = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_STATUS.items()) + " ELSE 'Failed' END"
_REC = f"rec AS (SELECT c_custkey AS id, c_name AS source_filename, {_STATUS} AS status, c_nationkey::BIGINT AS project_id, c_acctbal AS duration_sec FROM customer)"
_JOB = "job AS (SELECT o_orderkey AS id, o_custkey AS recording_id, o_orderpriority AS type, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'started' WHEN 'F' THEN 'finished' END AS status, o_orderdate AS created_at, o_orderdate + to_days((o_orderkey % 41)::INT) AS updated_at FROM orders)"
_CAL = f"cal AS (SELECT 'e' || event_id AS event_id, user_id % 4 AS source_id, {MS} AS starts_ms, {MS} + round(value * 20000)::BIGINT AS ends_ms FROM events WHERE event_type = 'signup')"
_WEIGHTS = "kw AS (SELECT user_id % 10 AS project_id, event_type || ':' || ((props->>'$.k')::BIGINT % 20) AS keyword, round(value * 100)::BIGINT AS cents, event_id AS seq FROM events)"
_VALUES = "(VALUES ('Queued'), ('Processing'), ('Stopping'), ('Stopped'), ('NeedsReview'), ('Ready'), ('Published'), ('Quarantine'), ('Failed')) v(status)"

QUERIES = {
    "status_counts_zero_filled": (status_counts, f"WITH {_REC} SELECT v.status, count(rec.id) AS n FROM {_VALUES} LEFT JOIN rec USING (status) GROUP BY 1"),
    "job_counts_zero_filled": (job_status_counts, f"WITH {_JOB} SELECT v.status, count(job.id) AS n FROM (VALUES ('queued'), ('started'), ('finished'), ('failed')) v(status) LEFT JOIN job USING (status) GROUP BY 1"),
    "recordings_page": (recordings_page, f"WITH {_REC} SELECT id, source_filename, status, n_name AS project_name, duration_sec FROM rec LEFT JOIN nation ON n_nationkey = project_id WHERE status = 'Ready' ORDER BY duration_sec DESC, id LIMIT 100 OFFSET 100"),
    "recordings_search": (recordings_search, f"WITH {_REC} SELECT id, source_filename, status FROM rec WHERE contains(lower(id::VARCHAR), 'r#0000001') OR contains(lower(source_filename), 'r#0000001')"),
    "jobs_page": (jobs_page, f"WITH {_JOB} SELECT id, recording_id, type FROM job WHERE status = 'queued' ORDER BY created_at DESC, id DESC LIMIT 500"),
    "stale_started_jobs": (stale_started_jobs, f"WITH {_REC}, {_JOB} SELECT job.id, recording_id, rec.status AS recording_status FROM job JOIN rec ON rec.id = recording_id WHERE job.status = 'started' AND created_at < TIMESTAMP '{CUTOFF}'"),
    "recordings_without_started_job": (recordings_without_started_job, f"WITH {_REC}, {_JOB} SELECT id, status FROM rec WHERE status IN ('Processing', 'Queued') AND NOT EXISTS (SELECT 1 FROM job WHERE job.recording_id = rec.id AND job.status = 'started')"),
    "active_job_per_recording": (active_job_per_recording, f"WITH {_JOB} SELECT recording_id, id, type, status FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY status = 'started' DESC, updated_at DESC, created_at DESC, id DESC) AS r FROM job WHERE status IN ('started', 'queued')) WHERE r = 1"),
    "event_counts_by_source": (event_counts_by_source, f"WITH {_CAL} SELECT n_nationkey::BIGINT AS source_id, n_name AS name, count(event_id) AS events FROM nation LEFT JOIN cal ON source_id = n_nationkey GROUP BY 1, 2"),
    "calendar_window_overlap": (calendar_window_overlap, f"WITH {_CAL} SELECT * FROM cal WHERE starts_ms < 1705190400000 AND ends_ms > 1704585600000"),
    "content_duplicates": (
        content_duplicates,
        "WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256 FROM documents) SELECT *, min(doc_id) OVER (PARTITION BY size, sha256) AS first_key, count(*) OVER (PARTITION BY size, sha256) AS copies FROM d",
    ),
    "newest_samples": (newest_samples, "SELECT * FROM (SELECT label::BIGINT AS voice_profile_id, vec_id AS sample_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank, count(*) OVER (PARTITION BY label) > 3 AS has_more FROM embeddings) WHERE rank <= 3"),
    "retention_cutoff": (retention_cutoff, f"WITH {_REC}, {_JOB}, l AS (SELECT recording_id, max(created_at) AS u FROM job GROUP BY 1) SELECT id FROM rec LEFT JOIN l ON id = recording_id WHERE status = 'Quarantine' AND coalesce(u, TIMESTAMP '1990-01-01') <= TIMESTAMP '{CUTOFF}'"),
    "status_cas_update": (status_cas_update, f"WITH {_REC}, {_JOB}, g AS (SELECT *, status = 'Processing' AND NOT EXISTS (SELECT 1 FROM job WHERE job.recording_id = rec.id AND job.status = 'started') AS changed FROM rec) SELECT id, CASE WHEN changed THEN 'NeedsReview' ELSE status END AS status, changed FROM g"),
    "job_commands": (
        job_commands,
        f"""WITH {_JOB}, c AS (SELECT *, (id % 9)::INT AS k FROM job), m AS (
  SELECT *, CASE WHEN k IN (1, 4, 6) THEN status IS NOT NULL WHEN k IN (0, 4, 7) THEN status = 'queued' WHEN k = 3 THEN status = 'queued' ELSE status = 'started' END AS ok FROM (
    SELECT * REPLACE (CASE k WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE k END AS k) FROM c)
), n AS (
  SELECT id, status, created_at, coalesce(ok, FALSE) AS moved, k IN (0) AS starts, k IN (1, 2) AS requeues, k IN (3, 4, 5) AS finishes FROM m
) SELECT id, CASE WHEN NOT moved THEN status WHEN starts THEN 'started' WHEN requeues THEN 'queued' WHEN finishes THEN 'finished' ELSE 'failed' END AS status, (1 + (moved AND starts)::INT)::BIGINT AS attempt,
  CASE WHEN NOT moved THEN 'old' WHEN NOT starts THEN 'new' END AS error, CASE WHEN NOT moved THEN created_at WHEN starts THEN TIMESTAMP '2000-01-01' WHEN NOT requeues THEN created_at END AS started_at,
  CASE WHEN NOT moved THEN created_at WHEN NOT starts AND NOT requeues THEN TIMESTAMP '2000-01-01' END AS finished_at, moved FROM n""",
    ),
    "reaper_outcome": (
        reaper_outcome,
        f"""WITH {_REC}, {_JOB}, r AS (SELECT rec.id, rec.status, min(updated_at) AS u FROM rec JOIN job ON recording_id = rec.id GROUP BY 1, 2
), late AS (SELECT * FROM job WHERE status = 'started' AND created_at < TIMESTAMP '{CUTOFF}'
), running AS (SELECT recording_id FROM job WHERE status = 'started' AND created_at >= TIMESTAMP '{CUTOFF}'
), s AS (SELECT id FROM r WHERE status IN ('Queued', 'Processing', 'Stopping', 'NeedsReview') AND id IN (SELECT recording_id FROM late) AND id NOT IN (SELECT recording_id FROM running)
), o AS (SELECT id FROM r WHERE status IN ('Processing', 'Stopping') AND u < TIMESTAMP '{CUTOFF}' AND id NOT IN (SELECT id FROM s) AND id NOT IN (SELECT recording_id FROM running)
), q AS (SELECT id, recording_id FROM job WHERE status = 'queued' AND recording_id IN (SELECT id FROM o) QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY updated_at DESC, created_at DESC, id DESC) = 1
), f AS (SELECT recording_id, count(*) AS n FROM (SELECT id, recording_id FROM late UNION ALL SELECT * FROM q) GROUP BY 1)
SELECT r.id, CASE WHEN r.id IN (SELECT id FROM s UNION SELECT id FROM o) THEN 'NeedsReview' ELSE status END AS status, r.id IN (SELECT id FROM s UNION SELECT id FROM o) AS recovered, coalesce(n, 0)::BIGINT AS failed_jobs
FROM r LEFT JOIN f ON f.recording_id = r.id""",
    ),
    "calendar_syncs": (
        calendar_syncs,
        f"""WITH {_CAL}, w AS (SELECT k AS sync_id, source_id, 1704585600000 AS low, 1704585600000 + k * 604800000 AS high FROM (VALUES (1), (2), (3)) v(k), (SELECT DISTINCT source_id FROM cal WHERE source_id % 2 = 0)
), seen AS (SELECT event_id, source_id, starts_ms + 60000 AS s, ends_ms + 60000 AS e FROM cal WHERE event_id[2:]::BIGINT % 3 > 0
), x AS (SELECT -1 AS sync_id, source_id, event_id, starts_ms, ends_ms FROM cal UNION ALL SELECT w.sync_id, w.source_id, event_id, s, e FROM w JOIN seen ON w.source_id = seen.source_id AND s < high AND e > low
), k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY source_id, event_id, starts_ms ORDER BY sync_id DESC, ends_ms DESC) = 1)
SELECT source_id, event_id, starts_ms, ends_ms FROM k WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.source_id = k.source_id AND w.sync_id > k.sync_id AND starts_ms < high AND ends_ms > low)""",
    ),
    "upsert_stage_state": (
        stage_marks,
        f"""WITH {_JOB}, l AS (SELECT recording_id, status, max(created_at) AS seen FROM job GROUP BY 1, 2), s AS (SELECT recording_id, seen FROM l WHERE status = 'finished'), k AS (SELECT recording_id, seen, recording_id % 2 = 0 AS run FROM l WHERE status = 'queued')
SELECT coalesce(s.recording_id, k.recording_id) AS recording_id, CASE WHEN k.run IS NULL THEN 'finished' WHEN k.run THEN 'running' ELSE 'completed' END AS status,
  (CASE WHEN k.run THEN (s.seen IS NOT NULL)::INT + 1 ELSE 1 END)::BIGINT AS attempt, CASE WHEN k.run THEN NULL WHEN k.run IS NULL THEN 0 ELSE greatest(0, date_diff('millisecond', coalesce(s.seen, k.seen), k.seen)) END AS duration_ms
FROM s FULL JOIN k ON s.recording_id = k.recording_id""",
    ),
    "calendar_replace_window": (
        calendar_replace_window,
        f"""WITH {_CAL}, n AS (SELECT event_id, 1::BIGINT AS source_id, starts_ms + 60000 AS starts_ms, ends_ms + 60000 AS ends_ms FROM cal WHERE source_id = 2 AND starts_ms < 1705190400000 AND ends_ms > 1704585600000)
SELECT * FROM cal WHERE NOT (source_id = 1 AND starts_ms < 1705190400000 AND ends_ms > 1704585600000) AND (source_id, event_id, starts_ms) NOT IN (SELECT source_id, event_id, starts_ms FROM n) UNION ALL SELECT * FROM n""",
    ),
    "weights_upsert": (weights_upsert, f"WITH {_WEIGHTS} SELECT project_id, keyword, sum(cents)::BIGINT AS cents FROM kw GROUP BY 1, 2"),
    "entity_merge": (entity_merge, "SELECT (label - label % 2)::BIGINT AS voice_profile_id, count(*) AS samples, min(vec_id) AS first_sample FROM embeddings GROUP BY 1"),
}
