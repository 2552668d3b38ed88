"""Voice snippets: windows around segments, their purity, and the ranking of a speaker's best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.asof import as_of, running_total
from colloquy.functions.intervals import coalesced, half_up
from colloquy.functions.lineage import cut

#: The overlap with others that a snippet may have.
MAX_OVERLAP_MS, MAX_OVERLAP_RATIO = 50, 0.02


def snippet_window(start: Column, end: Column, *, pad_ms: int = 250, max_ms: int = 8000, length: Column | None = None) -> tuple[Column, Column]:
    """A padded window, cut to ``max_ms`` around the segment's middle, never before 0 nor, where it is known, after the recording's ``length``."""
    known = length.isNotNull() & (length > 0) if length is not None else F.lit(False)
    most = F.when(known, length) if length is not None else F.lit(None).cast("long")
    base_start = F.greatest(F.lit(0), start - pad_ms)
    base_end = F.least(F.greatest(base_start, end + pad_ms), most)  # least skips nulls
    base_start = F.least(base_start, base_end)
    cut = base_end - base_start > max_ms
    centred = F.floor((start + F.greatest(start, end)) / 2) - max_ms // 2
    centred = F.least(centred, most - max_ms)
    clip_start = F.when(cut, F.greatest(F.lit(0), centred)).otherwise(base_start)
    return clip_start, F.when(cut, clip_start + max_ms).otherwise(base_end)


def others_speech(segments: DataFrame) -> DataFrame:
    """(recording_id, speaker, start_ms, end_ms, before): where anyone but the speaker speaks, and how long that is before."""
    spoken = cut(coalesced(segments, ["recording_id", "speaker"]).select("recording_id", F.col("speaker").alias("other"), "start_ms", "end_ms"))
    people = segments.select("recording_id", "speaker").distinct()
    islands = coalesced(people.join(spoken, "recording_id").where("speaker <> other"), ["recording_id", "speaker"])
    islands = cut(islands.select("recording_id", "speaker", "start_ms", "end_ms")).withColumn("length", F.col("end_ms") - F.col("start_ms"))
    return running_total(islands, ["recording_id", "speaker"], at="start_ms", value="length", out="before")


def trimmed(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """Clips cut back to where others' speech that covers an edge ends or begins, and ``overlap_ms``, others' speech left inside.

    An edge meets at most one island of others' speech: the last one that begins before it.
    """
    by = ["recording_id", "speaker"]
    others = cut(others_speech(segments).select(*by, "start_ms", F.struct("start_ms", "end_ms", "before").alias("island")))
    asked = clips.withColumnRenamed("start_ms", "clip_start").withColumn("inside", F.col("end_ms") - 1).withColumnRenamed("end_ms", "clip_end")
    found = as_of(asked.withColumnRenamed("clip_start", "at"), others.withColumnRenamed("start_ms", "at"), by, at="at", value="island", out="low").withColumnRenamed("at", "clip_start")
    found = as_of(cut(found), others.withColumnRenamed("start_ms", "inside"), by, at="inside", value="island", out="high")
    start = F.when(F.col("clip_start") < F.col("low.end_ms"), F.col("low.end_ms")).otherwise(F.col("clip_start"))
    covered = F.col("clip_end") <= F.col("high.end_ms")
    end = F.when(covered, F.col("high.start_ms")).otherwise(F.col("clip_end"))
    until = lambda i: F.col(f"{i}.before") + F.col(f"{i}.end_ms") - F.col(f"{i}.start_ms")
    upto = F.when(covered, F.col("high.before")).otherwise(F.coalesce(until("high"), F.lit(0)))
    inner = F.greatest(F.lit(0), upto - F.coalesce(until("low"), F.lit(0)))
    out = found.withColumns({"start_ms": start, "end_ms": F.greatest(start, end), "overlap_ms": inner})
    return out.drop("clip_start", "clip_end", "inside", "low", "high")


def purity(length: Column, overlap_ratio: Column, *, max_ms: int = 8000, degraded: bool = False) -> Column:
    """0.85 for the share without overlap and 0.15 for the length, worked out in ten-thousandths."""
    clean = 10_000 - F.round(F.least(F.greatest(overlap_ratio, F.lit(0.0)), F.lit(1.0)) * 10_000).cast("long")
    score = half_up(clean * (17 * max_ms) + F.least(length, F.lit(max_ms)) * 30_000, F.lit(20 * max_ms))
    return F.greatest(score - (5000 if degraded else 0), F.lit(0)) / 10_000


def rejection(length: Column, overlap_ms: Column, overlap_ratio: Column, *, min_ms: int = 800, degraded: bool = False) -> Column:
    """Why a snippet can't be used; null if it can."""
    return (
        F.when(F.lit(degraded), "rejected_degraded")
        .when(length < max(min_ms, 0), "rejected_short")
        .when((overlap_ms > MAX_OVERLAP_MS) | (overlap_ratio > MAX_OVERLAP_RATIO), "rejected_overlap")
    )


def rank_snippets(segments: DataFrame, *, pad_ms: int = 250, max_ms: int = 8000, min_ms: int = 800, limit: int = 3, degraded: bool = False) -> DataFrame:
    """Every segment's snippet with its rank among its speaker's, and its status.

    Windows are trimmed at both edges where others speak; others' speech left inside counts once, however many speak. Ranks go by
    purity, overlap, length, and place. A column ``length_ms`` of segments bounds windows by the recording's length.
    """
    length = F.col("length_ms") if "length_ms" in segments.columns else None
    clip_start, clip_end = snippet_window(F.col("start_ms"), F.col("end_ms"), pad_ms=pad_ms, max_ms=max_ms, length=length)
    clips = segments.select("recording_id", "speaker", "seq", F.col("start_ms").alias("source_start"), F.col("end_ms").alias("source_end"), clip_start.alias("start_ms"), clip_end.alias("end_ms"))
    rows = trimmed(clips, segments)
    rows = rows.withColumn("duration_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))
    rows = rows.withColumn("overlap_ratio", F.when(F.col("duration_ms") > 0, half_up(F.col("overlap_ms") * 10_000, F.col("duration_ms")) / 10_000).otherwise(1.0))
    rows = rows.withColumn("purity_score", purity(F.col("duration_ms"), F.col("overlap_ratio"), max_ms=max_ms, degraded=degraded))
    rows = rows.withColumn("rejected", rejection(F.col("duration_ms"), F.col("overlap_ms"), F.col("overlap_ratio"), min_ms=min_ms, degraded=degraded))
    w = Window.partitionBy("recording_id", "speaker").orderBy(F.desc("purity_score"), "overlap_ratio", F.desc("duration_ms"), "source_start", "source_end", "seq")
    rows = rows.withColumn("position", F.row_number().over(w).cast("long"))
    usable = F.count_if(F.col("rejected").isNull()).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    status = F.coalesce("rejected", F.when(usable > limit, "rejected_rank_limit").otherwise("accepted"))
    rows = rows.withColumns({"status": status, "recommended": F.col("rejected").isNull() & (usable == 1) & F.lit(limit > 0)})
    return rows.select("recording_id", "speaker", "seq", F.col("start_ms").alias("clip_start_ms"), F.col("end_ms").alias("clip_end_ms"), "duration_ms", "overlap_ms", "overlap_ratio", "purity_score", "position", "status", "recommended")


def status_counts(snippets: DataFrame) -> DataFrame:
    """Accepted, rejected by reason, and speakers without any accepted snippet, per recording."""
    by_speaker = snippets.groupBy("recording_id", "speaker").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count("*").alias("n"))
    return by_speaker.groupBy("recording_id").agg(F.sum("accepted").alias("accepted"), F.sum("n").alias("snippets"), F.count_if(F.col("accepted") == 0).alias("speakers_without"))
