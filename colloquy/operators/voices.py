"""Voices of speakers: which parts of a recording to listen to, a hook for a model, and one vector for each speaker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A model takes a recording's id with start and end in milliseconds, and gives frames of numbers, or None.
Model = Callable[[str, int, int], list[list[float]] | None]


def longest_crops(segments: DataFrame, *, most: int = 5, crop_ms: int = 3000) -> DataFrame:
    """(recording_id, speaker, place, start_ms, end_ms): the middles of each speaker's longest segments.

    Longer ones first, then earlier ones; of a segment over ``crop_ms`` only the middle counts. Segments without a speaker or
    without length don't. Spark keeps but ``most`` of each speaker on either side of the shuffle.
    """
    length = F.col("end_ms") - F.col("start_ms")
    rows = segments.where((F.coalesce("speaker", F.lit("")) != "") & (length > 0))
    order = Window.partitionBy("recording_id", "speaker").orderBy(F.desc(length), "start_ms", "seq")
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(most, 1))
    cut = (length > crop_ms) & F.lit(crop_ms > 0)
    start = F.when(cut, F.call_function("div", F.col("start_ms") + F.col("end_ms") - crop_ms, F.lit(2))).otherwise(F.col("start_ms"))
    return top.select("recording_id", "speaker", "place", start.alias("start_ms"), F.when(cut, start + crop_ms).otherwise(F.col("end_ms")).alias("end_ms"))


def embedded(crops: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """Crops with the model's ``frames``; ``load`` makes the model once for a task, whose batches it then serves.

    A crop that the model fails on has null frames.
    """
    names = ["recording_id", "speaker", "place", "frames"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(recording: str, start: int, end: int) -> list[list[float]] | None:
            try:
                return model(recording, start, end)
            except Exception:  # noqa: BLE001  a model may fail in any way
                return None

        for f in frames:
            yield f.assign(frames=[one(r, int(a), int(b)) for r, a, b in zip(f["recording_id"], f["start_ms"], f["end_ms"], strict=True)])[names]

    return crops.mapInPandas(run, "recording_id string, speaker string, place int, frames array<array<double>>")


def pooled(frames: Column) -> Column:
    """The mean of a model's frames, place by place; null if there are none, if they differ in length, or if a number isn't finite."""
    first = F.try_element_at(frames, F.lit(1))
    even = (F.size(first) > 0) & F.forall(frames, lambda f: F.coalesce(F.size(f) == F.size(first), F.lit(False)))
    total = F.aggregate(F.slice(frames, F.lit(2), F.greatest(F.size(frames) - 1, F.lit(0))), first, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.size(frames))
    finite = F.forall(mean, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(even & F.coalesce(finite, F.lit(False)), mean)


def speaker_vectors(frames: DataFrame) -> DataFrame:
    """(recording_id, speaker, crops, vector): the mean over a speaker's crops; those of another length than the first usable one don't count."""
    rows = frames.select("recording_id", "speaker", "place", pooled(F.col("frames")).alias("v")).where("v IS NOT NULL")
    key = ["recording_id", "speaker"]
    sizes = rows.groupBy(*key).agg(F.min_by(F.size("v"), "place").alias("size"))
    fits = rows.join(sizes, key).where(F.size("v") == F.col("size"))
    places = fits.select(*key, F.posexplode("v").alias("at", "x")).groupBy(*key, "at").agg(F.avg("x").alias("x"), F.count("*").alias("crops"))
    held = F.array_sort(F.collect_list(F.struct("at", "x"))).alias("held")
    return places.groupBy(*key).agg(F.max("crops").alias("crops"), held).select(*key, "crops", F.col("held.x").alias("vector"))
