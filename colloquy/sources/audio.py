"""Durations and speech ratios of WAV files read by Spark's ``binaryFile`` source."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The loudness (of 16-bit samples) from which a frame counts as speech, and a frame's length.
THRESHOLD, FRAME_MS = 350, 30
MEASURES = "duration_sec double, speech_ratio double, frames int"


def measure(data: bytes | None, threshold: float = THRESHOLD, frame_ms: int = FRAME_MS) -> tuple:
    """Duration, share of loud frames, and frames of a WAV file; nulls for what can't be read."""
    try:
        with wave.open(io.BytesIO(data or b""), "rb") as f:
            rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return None, None, None
    if width not in (1, 2, 4) or not rate:
        return None, None, None
    samples = np.frombuffer(raw, np.uint8).astype(float) - 128 if width == 1 else np.frombuffer(raw, f"<i{width}").astype(float)
    samples = samples * {1: 256.0, 2: 1.0, 4: 1 / 65536}[width]
    step = max(1, rate * frame_ms // 1000) * channels
    n = -(-len(samples) // step)
    if not n:
        return 0.0, None, 0
    padded = np.pad(samples, (0, n * step - len(samples)), constant_values=np.nan).reshape(n, step)
    loud = np.sqrt(np.nanmean(padded**2, axis=1)) >= threshold
    return len(samples) / channels / rate, float(loud.mean()), int(n)


def wav_measures(content: Column) -> Column:
    @F.pandas_udf(MEASURES)
    def run(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(f) for f in files], columns=[f.split()[0] for f in MEASURES.split(", ")]).astype({"frames": "Int32"})

    return run(content)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "length", wav_measures(F.col("content")).alias("m")).select("path", "length", "m.*")
