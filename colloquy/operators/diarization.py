"""Diarization quality: profiles, flicker, overlap between speakers, and merging of similar speakers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.intervals import coalesced, distance, duration, holders, in_buckets, islands, overlap_pairs, ratio
from colloquy.operators.turns import ORDER

#: Limits of a recording that is like a dialog.
MAX_SPEAKERS, MIN_TOP_TWO, MAX_LOW_MASS, MIN_TURNS, MIN_ALTERNATION, MAX_OVERLAP = 4, 0.85, 0.12, 3, 0.55, 0.2
RETRY_DELTA, RETRY_TOP_TWO = 0.05, 0.75


def speaker_totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy("recording_id", "speaker").agg(F.sum(duration(F.col("start_ms"), F.col("end_ms"))).alias("total_ms"))


def profile_metrics(segments: DataFrame) -> DataFrame:
    """One row per recording: speakers, speech, coverage of the two main ones, alternation, overlap."""
    rows = segments.where((F.col("end_ms") > F.col("start_ms")) & (F.trim("speaker") != ""))
    by_size = Window.partitionBy("recording_id").orderBy(F.desc("total_ms"), "speaker")
    ranked = speaker_totals(rows).withColumn("position", F.row_number().over(by_size))
    whole = F.sum("total_ms").over(Window.partitionBy("recording_id"))
    low = (F.col("position") > 2) & (ratio(F.col("total_ms"), whole) <= MAX_LOW_MASS)
    ranked = ranked.withColumn("low", low)
    sums = ranked.groupBy("recording_id").agg(
        F.count("*").alias("speaker_count"),
        F.sum("total_ms").alias("total_ms"),
        F.sum(F.when(F.col("position") <= 2, F.col("total_ms")).otherwise(0)).alias("top_two_ms"),
        F.count_if("low").alias("low_mass_speakers"),
        F.sum(F.when(F.col("low"), F.col("total_ms")).otherwise(0)).alias("low_mass_ms"),
    )
    top = ranked.where("position <= 2").select("recording_id", "speaker")
    main = islands(rows.join(top, ["recording_id", "speaker"], "left_semi"), ["recording_id"], ORDER, same=["speaker"], gap=1 << 50)
    turns = main.groupBy("recording_id").agg(F.count("*").alias("dominant_turns"), (F.max("island") - 1).alias("alternations"))
    swept = islands(rows, ["recording_id"], ORDER)
    covered = F.greatest(F.lit(0), F.least(F.coalesce("prev_end", F.lit(0)), F.col("end_ms")) - F.col("start_ms"))
    over = swept.groupBy("recording_id").agg(F.sum(covered).alias("overlap_ms"))
    m = sums.join(turns, "recording_id").join(over, "recording_id")
    return m.select(
        "recording_id", "speaker_count", "total_ms", "low_mass_speakers", "low_mass_ms", "dominant_turns", "overlap_ms",
        ratio(F.col("top_two_ms"), F.col("total_ms")).alias("top_two_coverage"),
        ratio(F.col("low_mass_ms"), F.col("total_ms")).alias("low_mass_coverage"),
        ratio(F.col("alternations"), F.greatest(F.col("dominant_turns") - 1, F.lit(1))).alias("alternation_ratio"),
        ratio(F.col("overlap_ms"), F.col("total_ms")).alias("overlap_ratio"),
    )


def dialog_like() -> Column:
    extra = F.greatest(F.col("speaker_count") - 2, F.lit(0))
    return (
        F.col("speaker_count").between(2, MAX_SPEAKERS)
        & (F.col("top_two_coverage") >= MIN_TOP_TWO)
        & (F.col("low_mass_speakers") >= extra)
        & (F.col("low_mass_coverage") <= MAX_LOW_MASS)
        & (F.col("dominant_turns") >= MIN_TURNS)
        & (F.col("alternation_ratio") >= MIN_ALTERNATION)
        & (F.col("overlap_ratio") <= MAX_OVERLAP)
    )


def dialog_score() -> Column:
    n = F.col("speaker_count")
    bonus = F.when(n == 2, 0.6).when(n == 1, 0.15).otherwise(F.greatest(F.lit(0.0), 0.45 - 0.15 * F.greatest(n - 2, F.lit(0))))
    return F.round(bonus + F.col("top_two_coverage") + F.col("alternation_ratio") - F.col("low_mass_coverage") - F.col("overlap_ratio"), 4)


def classify_profiles(metrics: DataFrame, *, turn_count: Column, duration_ms: Column, min_turns: int = 20, min_duration_ms: int = 600_000) -> DataFrame:
    """``profile``, ``reason`` and ``dialog_score`` of each recording, the first reason that holds."""
    enough_turns, enough_time = turn_count >= max(min_turns, 1), duration_ms >= max(min_duration_ms, 0)
    n, like, extra = F.col("speaker_count"), dialog_like(), F.greatest(F.col("speaker_count") - 2, F.lit(0))
    dialog = (like | (n == 1)) & enough_turns & enough_time
    reason = (
        F.when((n == 1) & dialog, "single_speaker_long_recording")
        .when(like & dialog, "dominant_pair_dialog_like")
        .when(n == 0, "no_valid_speakers")
        .when(n == 1, "single_speaker_short_recording")
        .when(like & ~enough_turns, "dialog_like_below_min_turns")
        .when(like & ~enough_time, "dialog_like_below_min_duration")
        .when(n > MAX_SPEAKERS, "too_many_speakers")
        .when(F.col("low_mass_speakers") < extra, "non_tiny_extra_speakers")
        .when(F.col("top_two_coverage") < MIN_TOP_TWO, "low_top_two_coverage")
        .when(F.col("low_mass_coverage") > MAX_LOW_MASS, "too_much_low_mass_speech")
        .when(F.col("dominant_turns") < MIN_TURNS, "insufficient_dominant_turns")
        .when(F.col("alternation_ratio") < MIN_ALTERNATION, "low_turn_alternation")
        .otherwise("high_overlap")
    )
    return metrics.withColumns({"profile": F.when(dialog, "dialog").otherwise("meeting"), "reason": reason, "dialog_score": dialog_score()})


def choose_retry(initial: DataFrame, retry: DataFrame) -> DataFrame:
    """Of two classified passes over a recording, the one to keep, with the reason."""
    cols = ["recording_id", "profile", "speaker_count", "dominant_turns", "top_two_coverage", "dialog_score"]
    a, b = initial.select(cols).alias("a"), retry.select(cols).alias("b")
    reason = (
        F.when(F.col("b.profile") != "dialog", "dialog_retry_not_dialog_like")
        .when(F.col("b.speaker_count") < 2, "dialog_retry_single_speaker")
        .when(F.col("b.dominant_turns") < 2, "dialog_retry_pathological_turns")
        .when(F.col("b.top_two_coverage") < RETRY_TOP_TWO, "dialog_retry_low_top_two_coverage")
        .when(F.col("b.dialog_score") <= F.col("a.dialog_score") + RETRY_DELTA, "dialog_retry_not_better")
        .otherwise("dialog_retry_improved_dialog_score")
    )
    joined = a.join(b, F.col("a.recording_id") == F.col("b.recording_id"))
    return joined.select(
        "a.recording_id",
        reason.alias("winner_reason"),
        F.when(reason == "dialog_retry_improved_dialog_score", "dialog_retry").otherwise("initial_pass").alias("selected_result"),
        F.col("a.dialog_score").alias("initial_score"),
        F.col("b.dialog_score").alias("retry_score"),
    )


def max_runs(segments: DataFrame) -> DataFrame:
    """Each speaker's longest row of consecutive segments in a recording."""
    rows = islands(segments, ["recording_id"], ORDER, same=["speaker"], gap=1 << 50)
    runs = rows.groupBy("recording_id", "island", "speaker").agg(F.count("*").alias("n"))
    return runs.groupBy("recording_id", "speaker").agg(F.max("n").alias("max_run"))


def relabel_flicker(segments: DataFrame, *, min_total_ms: int = 3000, max_run: int = 2, reach_ms: int = 600_000) -> DataFrame:
    """Segments of brief, scattered speakers get the speaker of the nearest segment of another kind.

    The nearest is the one with the least gap, then the earliest in order. A flicker segment meets the
    stable segments near it in buckets of time first; only those that find none within ``reach_ms``
    meet all of the recording's.
    """
    marks = speaker_totals(segments).join(max_runs(segments), ["recording_id", "speaker"])
    marks = marks.withColumn("flicker", (F.col("total_ms") < min_total_ms) & (F.col("max_run") <= max_run))
    rows = segments.join(marks.select("recording_id", "speaker", "flicker"), ["recording_id", "speaker"])
    brief = rows.where("flicker").select("recording_id", "seq", F.col("start_ms").alias("fs"), F.col("end_ms").alias("fe"))
    stable = rows.where(~F.col("flicker")).select("recording_id", "speaker", F.col("seq").alias("s_seq"), "start_ms", "end_ms")
    far = distance(F.col("fs"), F.col("fe"), F.col("start_ms"), F.col("end_ms"))
    first = F.min(F.struct(far.alias("far"), "start_ms", "end_ms", "speaker", "s_seq")).alias("best")
    around = brief.withColumns({"ls": F.col("fs") - reach_ms, "le": F.col("fe") + reach_ms})
    met = in_buckets(around, "ls", "le", reach_ms).join(in_buckets(stable, "start_ms", "end_ms", reach_ms), ["recording_id", "bucket"])
    close = met.groupBy("recording_id", "seq").agg(first).where(F.col("best.far") <= reach_ms)
    alone = brief.join(close, ["recording_id", "seq"], "left_anti")
    distant = alone.join(stable, "recording_id").groupBy("recording_id", "seq").agg(first)
    best = close.union(distant).select("recording_id", "seq", F.col("best.speaker").alias("new_speaker"))
    out = rows.join(best, ["recording_id", "seq"], "left")
    return out.select(*[F.coalesce("new_speaker", "speaker").alias(c) if c == "speaker" else F.col(c) for c in segments.columns], "flicker")


def speakers_overlap(segments: DataFrame, *, tolerance_ms: int = 100) -> DataFrame:
    """Pairs of speakers of which some segments share more than the tolerance.

    The later of two such segments starts in the union of the other speaker's, each without its last ``tolerance_ms``.
    """
    rows = segments.where("end_ms > start_ms").select("recording_id", "speaker", "start_ms", "end_ms")
    least = max(tolerance_ms, 0)
    later = rows.where(F.col("end_ms") - F.col("start_ms") > least)
    found = holders(later, later.withColumn("end_ms", F.col("end_ms") - least - 1), ["recording_id"], "speaker", at="start_ms").where("speaker <> holder")
    return found.select("recording_id", F.least("speaker", "holder").alias("speaker_a"), F.greatest("speaker", "holder").alias("speaker_b")).distinct()


def overlap_ratios(segments: DataFrame) -> DataFrame:
    """Overlap of any two speakers' speech over the shorter of their totals, for pairs that overlap."""
    united = coalesced(segments, ["recording_id", "speaker"]).select("recording_id", "speaker", "start_ms", "end_ms")
    totals = united.groupBy("recording_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"))
    pairs = overlap_pairs(united, united, ["recording_id"]).where("a_speaker < b_speaker")
    shared = F.sum(F.least("a_end_ms", "b_end_ms") - F.greatest("a_start_ms", "b_start_ms")).alias("overlap_ms")
    found = pairs.groupBy(F.col("a_recording_id").alias("recording_id"), F.col("a_speaker").alias("speaker_a"), F.col("b_speaker").alias("speaker_b")).agg(shared)
    for side in ("a", "b"):
        found = found.join(totals.select("recording_id", F.col("speaker").alias(f"speaker_{side}"), F.col("total").alias(f"total_{side}")), ["recording_id", f"speaker_{side}"])
    return found.select("recording_id", "speaker_a", "speaker_b", "overlap_ms", ratio(F.col("overlap_ms"), F.least("total_a", "total_b")).alias("overlap_ratio"))


def profile_hints() -> dict[str, tuple[int | None, int | None]]:
    """Least and most speakers to ask a diarizer for."""
    return {"dialog": (2, 2), "meeting": (2, 6), "auto": (None, None)}


def _seconds_overlap(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    """Share of the shorter of two sets of intervals that they have in common."""

    def united(xs: list[tuple[int, int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for s, e in sorted(x for x in xs if x[1] > x[0]):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return out

    a, b = united(a), united(b)
    shorter = min(sum(e - s for s, e in a), sum(e - s for s, e in b))
    shared = sum(max(0, min(e, f) - max(s, t)) for s, e in a for t, f in b)
    return shared / shorter if shorter > 0 else 0.0


def merge_similar_speakers(segments: DataFrame, similarity: DataFrame, *, least: float = 0.70, max_overlap: float = 0.05) -> DataFrame:
    """(recording_id, speaker, merged_into): speakers with similar voices that never talk at once.

    Pairs are taken from the most similar down to ``least`` and merged into the longer speaker
    unless they overlap; overlap and totals follow earlier merges, so a recording's pairs are
    worked off in order, in one grouped call per recording. ``similarity`` has speaker_a,
    speaker_b and similarity; a recording's segments and speakers must fit a task.
    """
    pairs = similarity.select([F.col(c).alias(c) for c in ("recording_id", "speaker_a", "speaker_b", "similarity")])

    def merge(own: pd.DataFrame, scored: pd.DataFrame) -> pd.DataFrame:
        spans = {k: list(zip(g["start_ms"], g["end_ms"], strict=True)) for k, g in own.groupby("speaker")}
        total = {k: sum(max(0, e - s) for s, e in v) for k, v in spans.items()}
        into = {k: k for k in spans}
        for a, b, near in sorted(zip(scored["speaker_a"], scored["speaker_b"], scored["similarity"], strict=True), key=lambda x: (-x[2], x[0], x[1])):
            x, y = into.get(a, a), into.get(b, b)
            if x == y or x not in spans or y not in spans:
                continue
            if near < least:
                break
            if _seconds_overlap(spans[x], spans[y]) > max_overlap:
                continue
            kept, gone = (x, y) if (-total[x], x) < (-total[y], y) else (y, x)
            spans[kept] += spans.pop(gone)
            total[kept] += total.pop(gone)
            into = {k: kept if v == gone else v for k, v in into.items()}
        rid = own["recording_id"].iloc[0] if len(own) else None
        return pd.DataFrame([(rid, k, v) for k, v in sorted(into.items())], columns=["recording_id", "speaker", "merged_into"])

    own = segments.select("recording_id", "speaker", "start_ms", "end_ms")
    return own.groupBy("recording_id").cogroup(pairs.groupBy("recording_id")).applyInPandas(merge, "recording_id string, speaker string, merged_into string")
