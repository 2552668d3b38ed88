"""Streams with state and timers against their batch forms."""

import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from colloquy.streaming import reaper, sync

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, reaper.STORE)
    yield spark
    spark.conf.unset(name)


def files(spark, rows, schema, parts):
    """Rows in files of their own, so that each is a micro-batch."""
    at = tempfile.mkdtemp(prefix="spark-")
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(f"{at}/{k:03d}")
    return at


def stream(spark, at, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)


def test_stuck_jobs_come_once_by_timer(rocks):
    hour = lambda h: T0 + timedelta(hours=h)
    rows = [
        (1, 0, hour(0), "start"), (2, 1, hour(0), "start"), (3, 2, hour(1), "start"), (1, 3, hour(2), "finish"),
        (3, 4, hour(4), "start"), (4, 5, hour(5), "finish"), (2, 6, hour(20), "finish"), (5, 7, hour(21), "start"), (6, 8, hour(21), "start"), (6, 9, hour(33.5), "finish"), (7, 10, hour(60), "start"),
    ]
    at = files(rocks, rows, reaper.COMMANDS, [(0, 1, 2, 3), (4, 5), (6, 7, 8), (9,), (10,)])
    commands = stream(rocks, at, reaper.COMMANDS).withWatermark("ts", "1 hour")
    q = reaper.recovered_stream(commands, timedelta(hours=12)).writeStream.format("memory").queryName("stuck").outputMode("append")
    q = q.option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted(map(tuple, rocks.table("stuck").collect()))
    batch = reaper.recovered(rocks.createDataFrame(rows, reaper.COMMANDS), "12 HOUR", until=F.lit(hour(59)))
    assert got == sorted(map(tuple, batch.collect()))
    assert [r[0] for r in got] == [2, 3, 5, 6]


def test_reaper_on_both_kinds_of_stuck_recordings(spark):
    jobs = spark.createDataFrame(
        [(1, "a", "started", 1, 1, 1), (2, "b", "started", 1, 1, 1), (3, "b", "started", 9, 9, 9), (4, "c", "queued", None, 2, 2), (5, "c", "queued", None, 3, 2), (6, "d", "started", 9, 9, 9), (7, "e", "started", 1, 1, 1), (8, "f", "queued", None, 1, 1), (9, "z", "started", 1, 1, 1)],
        "id long, recording_id string, status string, started_at long, updated_at long, created_at long",
    )
    recordings = spark.createDataFrame([("a", "Processing", 1), ("b", "Processing", 1), ("c", "Processing", 1), ("d", "Processing", 1), ("e", "Ready", 1), ("f", "Processing", 9), ("g", "Stopping", 2)], "id string, status string, updated_at long")
    after, rows = reaper.reap(jobs, recordings, F.lit(5))
    assert {r["id"] for r in after.where("recovered").collect()} == {1, 2, 5, 7}
    assert {r["status"] for r in after.where("recovered").collect()} == {"failed"}
    assert {r["id"]: r["status"] for r in rows.collect()} == {"a": "NeedsReview", "b": "Processing", "c": "NeedsReview", "d": "Processing", "e": "Ready", "f": "Processing", "g": "NeedsReview"}


def test_syncs_replace_windows_and_replays_change_nothing(spark):
    found = [(1, 1, 0, 100, "a", 10, 20), (1, 1, 0, 100, "b", 90, 120), (1, 2, 0, 100, "a", 10, 20), (2, 1, 0, 100, "b", 90, 120), (3, 1, 50, 200, None, None, None), (3, 2, 0, 5, None, None, None), (4, 1, 0, 60, "c", 30, 40), (4, 1, 0, 60, "c", 30, 45)]
    at = files(spark, found, sync.SYNCS, [(0, 1, 2), (3,), (4, 5), (6, 7)])
    out = tempfile.mkdtemp(prefix="spark-") + "/calendar"
    q = sync.sync_stream(stream(spark, at, sync.SYNCS), out, tempfile.mkdtemp(prefix="spark-"))
    q.awaitTermination(180)
    syncs = spark.createDataFrame(found, sync.SYNCS)
    empty = sync.version(spark, out, -1)
    whole = sorted(map(tuple, sync.replaced(empty, syncs).collect()))
    assert whole == sorted(map(tuple, sync.version(spark, out, 3).collect())) == [(1, "c", 30, 45), (2, "a", 10, 20)]
    sync.replaced(sync.version(spark, out, 2), syncs.where("sync_id = 4")).write.mode("overwrite").parquet(f"{out}/batch=3")
    assert whole == sorted(map(tuple, sync.version(spark, out, 3).collect()))
