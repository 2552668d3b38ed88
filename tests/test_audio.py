import io
import tempfile
import wave

import numpy as np

from colloquy.sources import audio


def wav(samples, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.array(samples, "<i2").tobytes())
    return out.getvalue()


def test_speech_ratio(spark):
    half = wav([0] * 2400 + [3000, -3000] * 1200)
    assert audio.measure(half) == (0.6, 0.5, 20)
    assert audio.measure(b"no wav") == (None, None, None) == audio.measure(None)
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, data in (("a.wav", half), ("b.wav", b"junk")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    got = {r["path"][-5:]: (r["duration_sec"], r["speech_ratio"]) for r in audio.read_wavs(spark, folder).collect()}
    assert got == {"a.wav": (0.6, 0.5), "b.wav": (None, None)}
