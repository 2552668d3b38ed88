"""Chunks of long transcripts: their states after marks, what can be resumed, and splitting those that took too long."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.operators.text import chunks
from colloquy.sources.schemas import CHUNK_STATUSES

KEY = ["recording_id", "chunk_group", "chunk_index"]
MARKS = "recording_id string, chunk_group string, chunk_index string, seq long, at timestamp, status string, error string, parent string, transcript_hash string"
STATES = "recording_id string, chunk_group string, chunk_index string, status string, attempt long, started_at timestamp, finished_at timestamp, error string, parent string, transcript_hash string"


def keyed(rows: DataFrame) -> DataFrame:
    """Groups and indexes without blanks around them, in lower case; an unknown status fails."""
    clean = {c: F.lower(F.trim(c)) for c in ("chunk_group", "chunk_index")}
    status = F.lower(F.trim("status"))
    bad = F.raise_error(F.concat(F.lit("unknown chunk status: "), F.coalesce("status", F.lit("null"))))
    return rows.withColumns(clean | {"status": F.when(status.isin(*CHUNK_STATUSES), status).otherwise(bad)})


def after_marks(states: DataFrame, marks: DataFrame) -> DataFrame:
    """States (``STATES``) after marks (``MARKS``), in the order of ``seq``.

    ``running`` counts an attempt, sets the start and clears end and error. Any other mark sets end and error, keeps the start,
    and makes an attempt of none. A null parent or hash keeps the one before. Each key's marks are summed up, never gathered.
    """
    rows = keyed(marks)
    running = F.col("status") == "running"
    last = lambda c, keep=None: F.max_by(c, F.when(F.col(c).isNotNull() if keep is None else keep, F.col("seq")))
    sums = rows.groupBy(*KEY).agg(
        F.max_by(F.struct("status", "at", "error"), "seq").alias("last"),
        F.min_by(F.struct("status", "at"), "seq").alias("first"),
        F.count_if(running).alias("starts"),
        last("at", running).alias("started"),
        last("parent").alias("_parent"),
        last("transcript_hash").alias("_hash"),
    )
    both = keyed(states).join(sums, KEY, "full_outer")
    marked, ended = F.col("last").isNotNull(), F.col("last.status") != "running"
    held = F.coalesce("attempt", F.lit(0))
    extra = F.when((held == 0) & (F.col("first.status") != "running"), 1).otherwise(0)
    started = F.coalesce("started", "started_at", "first.at")
    return both.select(
        *KEY,
        F.coalesce("last.status", "status").alias("status"),
        F.when(marked, held + F.col("starts") + extra).otherwise(held).cast("long").alias("attempt"),
        F.when(marked, started).otherwise(F.col("started_at")).alias("started_at"),
        F.when(marked, F.when(ended, F.col("last.at"))).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(marked, F.when(ended, F.nullif(F.trim("last.error"), F.lit("")))).otherwise(F.col("error")).alias("error"),
        F.coalesce("_parent", "parent").alias("parent"),
        F.coalesce("_hash", "transcript_hash").alias("transcript_hash"),
    )


class ChunkStates(StatefulProcessor):
    """Keeps one chunk's state and emits it after every batch that marks it."""

    KEPT = "status string, attempt long, started long, error string, parent string, hash string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chunk", self.KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = tuple(self.state.get()) if self.state.exists() else (None, 0, None, None, None, None)
        finished = None
        marks = [r for f in rows for r in f.astype(object).where(f.notna(), None).to_dict("records")]
        for m in sorted(marks, key=lambda m: m["seq"]):
            _, attempt, started, _, parent, held = kept
            at = int(pd.Timestamp(m["at"]).value // 1000)
            if m["status"] == "running":
                started, finished, error, attempt = at, None, None, attempt + 1
            else:
                finished, error, attempt = at, (m["error"] or "").strip() or None, max(attempt, 1)
                started = at if started is None else started
            kept = (m["status"], attempt, started, error, m["parent"] or parent, m["transcript_hash"] or held)
        self.state.update(kept)
        moment = lambda us: None if us is None else datetime.fromtimestamp(us / 1e6, timezone.utc)
        row = [*key, kept[0], kept[1], moment(kept[2]), moment(finished), *kept[3:]]
        yield pd.DataFrame([row], columns=[c.split()[0] for c in STATES.split(", ")])

    def close(self) -> None:
        pass


def states_stream(marks: DataFrame) -> DataFrame:
    """``after_marks`` of a stream: each chunk's state again whenever a batch has marks for it. Marks of later batches have higher ``seq``."""
    return keyed(marks).groupBy(*KEY).transformWithStateInPandas(ChunkStates(), outputStructType=STATES, outputMode="update", timeMode="None")


def resumable(rows: DataFrame) -> DataFrame:
    """Chunks that can go on, with their ``position``: rows have STATES and order_path, text, base_text, and current_hash, their transcript's.

    A recording's rows count only if all of them, also those of split chunks, are of the current transcript and whole; split
    chunks then give way to their parts. Order is by path, number by number.
    """
    path = F.col("order_path")
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    whole = (F.trim(F.coalesce("transcript_hash", F.lit(""))) == F.col("current_hash")) & some("text") & some("base_text") & some("chunk_index") & (F.size(path) > 0) & F.forall(path, lambda x: x > 0)
    fits = rows.groupBy("recording_id").agg(F.bool_and(F.coalesce(whole, F.lit(False))).alias("fits")).where("fits").select("recording_id")
    active = rows.where(F.lower(F.trim("status")) != "split").join(fits, "recording_id", "left_semi")
    order = Window.partitionBy("recording_id").orderBy(path, "chunk_index")
    return active.withColumn("position", F.row_number().over(order).cast("long"))


def best_split(parts: DataFrame, by: list[str], *, order: str, size: str) -> DataFrame:
    """(by, split): how many of a group's parts go left so that both sides are nearest in size; the first such cut, 0 for one part."""
    w = Window.partitionBy(*by).orderBy(order)
    left = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = parts.select(*by, left.alias("left"), F.sum(size).over(Window.partitionBy(*by)).alias("total"), F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    delta = F.abs(F.col("total") - F.col("left") * 2)
    cut = F.min_by("k", F.when(F.col("k") < F.col("n"), F.struct(delta.alias("delta"), "k")))
    return rows.groupBy(*by).agg(F.coalesce(cut, F.lit(0)).cast("long").alias("split"))


def halves(text: str, least_chars: int) -> tuple[str, str] | None:
    """A chunk's text in two of about equal length, at line ends; None if it is too short or doesn't get shorter."""
    text = text.strip()
    if len(text) < max(2 * least_chars, 2):
        return None
    parts = [body.strip() for _, body in chunks(text, max(least_chars, len(text) // 2), 0)]
    total, done, best = sum(map(len, parts)), 0, (sum(map(len, parts)), 1)
    for k in range(1, len(parts)):
        done += len(parts[k - 1])
        best = min(best, (abs(total - 2 * done), k))
    sides = ["\n".join(p for p in side if p).strip() for side in (parts[: best[1]], parts[best[1] :])]
    return (sides[0], sides[1]) if all(sides) and max(map(len, sides)) < len(text) else None


def split_chunks(rows: DataFrame, slow: Column, *, least_chars: int = 1200, max_depth: int = 2) -> DataFrame:
    """Chunks (recording_id, chunk_index, order_path, base_text, start_ms, end_ms) after splitting those that are ``slow``, and slow parts again.

    A chunk becomes ``…a`` and ``…b``, with its time shared out by length; parent and depth are added. One plan of ``max_depth`` steps.
    """

    @F.pandas_udf("struct<a: string, b: string>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([halves(t or "", least_chars) or (None, None) for t in texts], columns=["a", "b"])

    front = rows.withColumns({"parent": F.lit(None).cast("string"), "depth": F.lit(0)})
    done = None
    for depth in range(max_depth):
        tried = front.withColumn("_cut", F.when(slow, cut("base_text")))
        kept = tried.where(F.col("_cut.a").isNull()).drop("_cut")
        done = kept if done is None else done.unionByName(kept)
        span = F.col("end_ms") - F.col("start_ms")
        share = F.length("_cut.a") / (F.length("_cut.a") + F.length("_cut.b"))
        middle = F.when(span >= 0, F.col("start_ms") + F.round(span * share).cast("long"))
        parts = []
        for name, side, k in (("a", "a", 1), ("b", "b", 2)):
            new = {"parent": F.col("chunk_index"), "chunk_index": F.concat("chunk_index", F.lit(name)), "depth": F.lit(depth + 1), "order_path": F.array_append("order_path", F.lit(k)), "base_text": F.col(f"_cut.{side}")}
            new |= {"end_ms": middle} if k == 1 else {"start_ms": middle}
            parts.append(tried.where(F.col("_cut.a").isNotNull()).withColumns(new).drop("_cut"))
        front = parts[0].unionByName(parts[1])
    return done.unionByName(front) if done is not None else front
