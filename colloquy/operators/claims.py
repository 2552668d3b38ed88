"""Which range of a recording each segment belongs to, and segments moved to their recording's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.intervals import in_buckets


def claimed(segments: DataFrame, ranges: DataFrame, *, bucket: int = 600_000) -> DataFrame:
    """``segments`` that a range (recording_id, place, start_ms, end_ms) touches, each with the ``place`` of the first one in order.

    A range is open: a segment that only ends or begins at its edge isn't touched. What an earlier range has claimed, later ones
    don't get. A segment that ends before it starts has no length. Ranges are sought in buckets of time by running minima; only those that
    begin and end in one bucket meet its segments one by one.
    """
    rows = segments.withColumn("_end", F.greatest("start_ms", F.coalesce("end_ms", "start_ms")))
    key = ["recording_id", "_cell"]
    asks = in_buckets(rows.select("recording_id", "seq", "start_ms", "_end"), "start_ms", "_end", bucket, "_cell")
    edges = [F.floor(F.col(c) / bucket).alias(n) for c, n in (("start_ms", "_first"), ("end_ms", "_last"))]
    marks = in_buckets(ranges.select("recording_id", "place", "start_ms", "end_ms", *edges), "start_ms", "end_ms", bucket, "_cell")
    short, begins, ends = F.col("_last") <= F.col("_first"), F.col("_cell") == F.col("_first"), F.col("_cell") == F.col("_last")
    # A range that begins in a cell is sought by low < end, one that ends there by high > start; those all over it count for all.
    over = marks.where(~short & ~begins & ~ends).groupBy(*key).agg(F.min("place").alias("_over"))
    inside = marks.where(short).select(*key, "place", F.col("start_ms").alias("low"), F.col("end_ms").alias("high"))
    sides = marks.where(~short & (begins | ends)).select(*key, "place", F.when(begins, F.col("start_ms")).alias("_up"), F.when(ends, F.col("end_ms")).alias("_down"))
    asked = asks.select(*key, "seq", F.col("_end").alias("_up"), F.col("start_ms").alias("_down"), F.lit(True).alias("_asks"))
    both = asked.unionByName(sides.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rising = ahead(Window.partitionBy(*key).orderBy("_up", F.desc("_asks")))
    falling = ahead(Window.partitionBy(*key).orderBy(F.desc("_down"), F.desc("_asks")))
    seen = both.withColumn("_b", F.min(F.when(F.col("_up").isNotNull(), F.col("place"))).over(rising)).withColumn("_e", F.min(F.when(F.col("_down").isNotNull(), F.col("place"))).over(falling))
    met = seen.where("_asks").join(over, key, "left").select("recording_id", "seq", F.least("_b", "_e", "_over").alias("place"))
    close = asks.join(inside, key).where((F.col("_end") > F.col("low")) & (F.col("start_ms") < F.col("high"))).select("recording_id", "seq", "place")
    met = met.where("place IS NOT NULL").unionByName(close).groupBy("recording_id", "seq").agg(F.min("place").alias("place"))
    return rows.drop("_end").join(met, ["recording_id", "seq"])


def moved(words: Column, offset: Column) -> Column:
    """Words (start_ms, end_ms, word) later by ``offset``; missing times stay missing."""
    return F.transform(words, lambda w: F.struct((w["start_ms"] + offset).alias("start_ms"), (w["end_ms"] + offset).alias("end_ms"), w["word"].alias("word")))


def in_recording(chunk_segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments of chunks (recording_id, place, seq, start_ms, end_ms, words, language) in their recording's time, with what their chunk tells.

    ``chunks`` has (recording_id, place, offset_ms, chunk_language, confidence, hint, uncertain, conflict). A segment without a language takes the chunk's;
    a missing start is 0, a missing end the start, and none ends before it starts; a conflict is uncertain, too.
    """
    rows = chunk_segments.join(chunks, ["recording_id", "place"])
    offset = F.col("offset_ms")
    start = F.coalesce("start_ms", F.lit(0)) + offset
    end = F.greatest(start, F.coalesce(F.col("end_ms") + offset, start))
    hinted = F.col("hint").isNotNull()
    return rows.withColumns(
        {
            "words": moved(F.col("words"), offset),
            "start_ms": start,
            "end_ms": end,
            "language": F.coalesce("language", "chunk_language"),
            "language_confidence": F.round("confidence", 4),
            "language_source": F.when(hinted, "chunk_hint").otherwise("chunk_detected"),
            "hint_applied": hinted,
            "uncertain": F.col("uncertain") | F.col("conflict"),
        }
    ).drop("offset_ms", "chunk_language", "confidence")
