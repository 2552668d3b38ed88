"""Jobs that got stuck: a started job without an end within a limit is recovered once, by a timer.

``recovered_stream`` keeps one start for each job and sets an event-time timer for its limit; ``recovered`` says the same of
a whole table. Commands (job_id, seq, ts, command) are ``start`` or anything else, which ends the job; a start of a started
job begins its time anew. Equal times go by ``seq``. Commands older than what a job's state holds do nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECOVERED = "job_id long, started_at timestamp, recovered_at timestamp"
COMMANDS = "job_id long, seq long, ts timestamp, command string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def recovered(commands: DataFrame, limit: str, *, until: Column | None = None) -> DataFrame:
    """(job_id, started_at, recovered_at) of the starts that no command of their job followed within ``limit``.

    A job's last start counts if its limit ends before ``until``; where that isn't given, every last start does.
    """
    w = Window.partitionBy("job_id").orderBy("ts", "seq")
    due = F.col("ts") + F.expr(f"INTERVAL {limit}")
    rows = commands.withColumn("next", F.lead("ts").over(w)).withColumn("due", due).where("command = 'start'")
    last = F.col("next").isNull() & (F.lit(True) if until is None else F.col("due") < until)
    return rows.where(last | (F.col("next") > F.col("due"))).select("job_id", F.col("ts").alias("started_at"), F.col("due").alias("recovered_at"))


def _moment(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


class Reaper(StatefulProcessor):
    """State of a job: when it was started, in microseconds; one timer for the millisecond after its limit."""

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "at long, seq long")

    def _alarm(self, at: int) -> int:
        return (at + self.limit_us) // 1000 + 1

    def _clear(self, at: int) -> None:
        self.handle.deleteTimer(self._alarm(at))
        self.started.clear()

    def _out(self, job: int, starts: list[int]) -> Iterator[pd.DataFrame]:
        if starts:
            yield pd.DataFrame({"job_id": [job] * len(starts), "started_at": [_moment(a) for a in starts], "recovered_at": [_moment(a + self.limit_us) for a in starts]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = [(int(pd.Timestamp(ts).tz_localize(None).value // 1000) if pd.Timestamp(ts).tzinfo is None else int(pd.Timestamp(ts).value // 1000), int(seq), command) for f in rows for ts, seq, command in zip(f["ts"], f["seq"], f["command"], strict=True)]
        stuck = []
        for at, seq, command in sorted(found):
            held = self.started.get() if self.started.exists() else None
            if held is not None:
                if (at, seq) < (held[0], held[1]):
                    continue
                if at > held[0] + self.limit_us:
                    stuck.append(held[0])
                self._clear(held[0])
            if command == "start":
                self.started.update((at, seq))
                self.handle.registerTimer(self._alarm(at))
        yield from self._out(key[0], stuck)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.started.get() if self.started.exists() else None
        if held is not None:
            self.started.clear()
            yield from self._out(key[0], [held[0]])

    def close(self) -> None:
        pass


def recovered_stream(commands: DataFrame, limit: timedelta) -> DataFrame:
    """As ``recovered``, of a stream with a watermark on ``ts``: each stuck start is emitted once, when its timer fires.

    It needs ``spark.sql.streaming.stateStore.providerClass`` to be RocksDB's (``STORE``).
    """
    reaper = Reaper(int(limit / timedelta(microseconds=1)))
    return commands.groupBy("job_id").transformWithStateInPandas(reaper, outputStructType=RECOVERED, outputMode="append", timeMode="EventTime")


#: What a recovery writes, and from which states it takes a recording.
ERROR, REASON = "stuck job recovered", "stuck_job_recovered"
STALE_FROM, ORPHAN_FROM = ("Queued", "Processing", "Stopping", "NeedsReview"), ("Processing", "Stopping")


def reap(jobs: DataFrame, recordings: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs and recordings after one run of the reaper; ``recovered`` tells which rows it changed.

    Jobs started before ``before`` fail, and so does the active queued job of a recording that is being processed without a
    started job since before then. Their recordings go to review unless another job of theirs has started. Jobs have id, recording_id,
    status, started_at, updated_at, created_at; recordings have id, status, updated_at.
    """
    known = recordings.select(F.col("id").alias("recording_id"))
    stale = (F.col("status") == "started") & (F.col("started_at") < before)
    late = jobs.where(stale).join(known, "recording_id", "left_semi").select("id", "recording_id")
    started = jobs.where("status = 'started'").groupBy(F.col("recording_id").alias("id")).agg(F.max(F.coalesce(stale, F.lit(False))).alias("_late"), F.max(~F.coalesce(stale, F.lit(False))).alias("_running"))
    flag = {c: F.coalesce(c, F.lit(False)) for c in ("_late", "_running")}
    rows = recordings.join(started, "id", "left").withColumns(flag).withColumn("_stale", F.col("_late") & ~F.col("_running") & F.col("status").isin(*STALE_FROM))
    waiting = ~F.col("_stale") & ~F.col("_running") & F.col("status").isin(*ORPHAN_FROM) & (F.col("updated_at") < before)
    rows = rows.withColumn("_orphan", F.coalesce(waiting, F.lit(False))).drop("_late", "_running")
    orphans = rows.where("_orphan").select(F.col("id").alias("recording_id"))
    latest = F.max_by("id", F.struct("updated_at", "created_at", "id"))
    queued = jobs.where("status = 'queued'").join(orphans, "recording_id", "left_semi").groupBy("recording_id").agg(latest.alias("id"))
    failed = late.select("id").union(queued.select("id")).withColumn("recovered", F.lit(True))
    out = jobs.join(failed, "id", "left").withColumn("recovered", F.col("recovered").isNotNull())
    out = out.withColumns({"status": F.when(F.col("recovered"), "failed").otherwise(F.col("status")), "error": F.when(F.col("recovered"), ERROR)})
    rows = rows.withColumn("recovered", F.col("_stale") | F.col("_orphan")).drop("_stale", "_orphan")
    return out, rows.withColumns({"status": F.when(F.col("recovered"), "NeedsReview").otherwise(F.col("status")), "review_reason_code": F.when(F.col("recovered"), REASON)})
