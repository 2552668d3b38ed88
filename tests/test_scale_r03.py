"""Findings of round 3: steps whose work grew faster than their input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions.asof import as_of
from colloquy.functions.intervals import holders
from colloquy.llm import lm_scoring
from colloquy.operators import calendar, claims, diarization, folding, text, turns
from colloquy.streaming import reaper

CAPTURE, EVENT = "recording_id long, captured_ms long, duration_sec double", "event_id string, starts_ms long, ends_ms long"


def _calendar(spark):
    captures = [(i, 3_600_000 * (i % 3), [50.0, None][i % 2]) for i in range(12)] + [(99, 10**12, 5.0)]
    events = [(f"e{i}", 600_000 * (i % 4), 600_000 * (i % 4) + 900_000 * (1 + i % 2)) for i in range(16)]
    return spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(events, EVENT)


def test_equal_captures_and_events_are_scored_once(spark):
    captures, events = _calendar(spark)
    assert calendar.candidates(*calendar.alike(captures, events)).count() == 6 * 4
    got = {r["recording_id"]: tuple(r) for r in calendar.summaries(captures, events).collect()}
    pairs = calendar.candidates(captures, events).collect()
    for k in range(12):
        scores = [r["score"] for r in pairs if r["recording_id"] == k]
        assert got.pop(k) == (k, len(scores), sum(s > 0 for s in scores), max(scores))
    assert not got


def test_decisions_of_equal_events(spark):
    captures, events = _calendar(spark)
    got = {r["recording_id"]: r for r in calendar.decisions(captures, events).collect()}
    pairs = calendar.candidates(captures, events).collect()
    for k in range(12):
        mine = sorted((-r["score"], r["starts_ms"], r["event_id"]) for r in pairs if r["recording_id"] == k)
        row = got[k]
        assert (row["candidates"], row["top_event_id"], row["top_score"]) == (len(mine), mine[0][2], -mine[0][0])
        assert row["margin_to_next"] == round(mine[1][0] - mine[0][0], 4)
    assert got[99]["reason"] == "no_candidates" and len(got) == 13


def test_decisions_of_distinct_times_score_few_pairs(spark, monkeypatch):
    rng = random.Random(12)
    captures = [(i, rng.randrange(2 * 3_600_000), rng.choice([None, 0.0, 0.5, 40.0, 300.0, 5000.0]) if i % 3 == 0 else round(rng.expovariate(1 / 50), 2)) for i in range(80)] + [(98, None, 5.0), (99, 10**12, 5.0)]
    events = [(f"e{i}", s, s + rng.choice([0, rng.randrange(90_000), rng.randrange(3_000_000)])) for i, s in enumerate(rng.randrange(2 * 3_600_000) for _ in range(1500))]
    captures, events = spark.createDataFrame(captures, CAPTURE), spark.createDataFrame(events, EVENT)
    scored = []
    pairs = calendar.candidates(captures, events).collect()

    def counting(frames):
        scored.append(frames.count())
        return frames

    for name in ("candidates", "nearby"):
        if hasattr(calendar, name):
            plain = getattr(calendar, name)
            monkeypatch.setattr(calendar, name, lambda *a, f=plain, **k: counting(f(*a, **k)))
    got = {r["recording_id"]: r for r in calendar.decisions(captures, events).collect()}
    for k in range(80):
        mine = sorted((-r["score"], r["starts_ms"], r["event_id"]) for r in pairs if r["recording_id"] == k)
        row = got[k]
        assert (row["candidates"], row["top_event_id"], row["top_score"], row["margin_to_next"]) == (len(mine), mine[0][2], -mine[0][0], round(mine[1][0] - mine[0][0], 4))
    assert got[98]["reason"] == got[99]["reason"] == "no_candidates" and len(got) == 82
    assert sum(scored) < len(pairs)  # two passes over all pairs, and more, without the near events first


SEGMENT = "recording_id string, seq long, speaker string, start_ms long, end_ms long, text string"


def _random_segments(seed, n=120, span=4000, longest=900):
    rng = random.Random(seed)
    begins = [rng.randrange(span) for _ in range(n)]
    return [(rng.choice("xy"), i, rng.choice("ABC"), s, s + rng.choice([-5, 0, 1, 300, rng.randrange(longest)]), "t") for i, s in enumerate(begins)]


def test_holders_are_found_once(spark):
    rows = _random_segments(1)
    points = spark.createDataFrame([(r, k, at) for r in "xy" for k, at in enumerate(range(0, 5000, 37))], "recording_id string, k long, at long")
    got = sorted(tuple(r) for r in holders(points, spark.createDataFrame(rows, SEGMENT), ["recording_id"], "speaker", at="at", bucket=500).collect())
    want = {(p["recording_id"], p["k"], p["at"], r[2]) for p in points.collect() for r in rows if r[0] == p["recording_id"] and r[3] <= p["at"] <= r[4]}
    assert got == sorted(want)


@pytest.mark.parametrize("bucket", [7, 500, 60_000])
def test_interruptions_by_unions(spark, bucket):
    rows = _random_segments(2)
    want = {(t[0], t[1], t[2], p[2]) for t in rows for p in rows if t[0] == p[0] and t[2] != p[2] and p[3] < t[3] < p[4] and min(p[4], t[4]) - t[3] >= 300}
    got = [tuple(r) for r in turns.interruption_events(spark.createDataFrame(rows, SEGMENT), bucket=bucket).collect()]
    assert sorted(got) == sorted(want)


def test_speakers_overlap_by_unions(spark):
    for seed, tolerance in ((3, 100), (4, 850), (5, 0)):
        rows = _random_segments(seed, n=30)
        want = {(a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and min(a[4], b[4]) - max(a[3], b[3]) > tolerance}
        assert {tuple(r) for r in diarization.speakers_overlap(spark.createDataFrame(rows, SEGMENT), tolerance_ms=tolerance).collect()} == want


@pytest.mark.parametrize("bucket", [100, 1000])
def test_claims_by_running_minima(spark, bucket):
    rows, rng = _random_segments(6), random.Random(7)
    ranges = [(rng.choice("xy"), k, s, s + rng.choice([0, 20, 400, 1500])) for k, s in enumerate(rng.randrange(-300, 4500) for _ in range(15))]
    got = {r["seq"]: r["place"] for r in claims.claimed(spark.createDataFrame(rows, SEGMENT), spark.createDataFrame(ranges, "recording_id string, place long, start_ms long, end_ms long"), bucket=bucket).collect()}
    hit = {r[1]: [k for x, k, low, high in ranges if x == r[0] and max(r[3], r[4]) > low and r[3] < high] for r in rows}
    assert got == {seq: min(ks) for seq, ks in hit.items() if ks}


@pytest.mark.parametrize("after", [False, True])
def test_least_of_all_marks_on_a_side(spark, after):
    rng = random.Random(8)
    marks = [("g", rng.randrange(100), rng.randrange(50)) for _ in range(20)]
    points = spark.createDataFrame([("g", i, i) for i in range(-3, 104)], "g string, id long, at long")
    got = {r["id"]: r["v"] for r in as_of(points, spark.createDataFrame(marks, "g string, at long, v long"), ["g"], at="at", value="v", out="v", after=after, least=True, bucket=9).collect()}
    assert got == {i: min((v for _, at, v in marks if (at >= i if after else at <= i)), default=None) for i in range(-3, 104)}


def test_words_inside_and_across_segments(spark):
    rows, rng = _random_segments(9, n=25, span=9000), random.Random(10)
    words = [(r, i, "", s, s + rng.choice([0, 5, 60, 400]), "w") for i, (r, s) in enumerate((rng.choice("xyz"), rng.randrange(9000)) for _ in range(150))]
    for bucket in (50, 10_000):
        got = {r["word"]: (r["speaker"], r["segment_seq"]) for r in turns.assign_speakers(spark.createDataFrame(words, SEGMENT), spark.createDataFrame(rows, SEGMENT), bucket=bucket).collect()}
        for r, i, _, s, e, _ in words:
            mine = [x for x in rows if x[0] == r]
            lap = lambda x: max(0, min(e, x[4]) - max(s, x[3]))  # noqa: B023, E731
            far = lambda x: max(0, 2 * x[3] - s - e, s + e - 2 * x[4])  # noqa: B023, E731
            best = min(mine, key=lambda x: (-lap(x), 0 if lap(x) else far(x), x[3], x[4], x[2], x[1]), default=None)
            assert got[i] == ((best[2], best[1]) if best else ("S1", None))


def test_word_turns_cuts_segments_into_words_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    asr = spark.createDataFrame([("x", k, 1000 * k, 1000 * k + 900, f"Word {k}. And more", None, None) for k in range(20)], f"recording_id string, seq long, start_ms long, end_ms long, text string, words {turns.WORDS}, language string")
    said = spark.createDataFrame([("x", k, "AB"[k // 10], 1000 * k, 1000 * k + 950, "t") for k in range(20)], "recording_id string, seq long, speaker string, start_ms long, end_ms long, text string")
    got = [(r["speaker"], r["n_words"]) for r in turns.word_turns(asr.withColumn("text", counted.asNondeterministic()("text")), said).orderBy("start_ms").collect()]
    assert got == [("A", 10), ("B", 10)]
    assert read.value == 20


def test_smooth_turns_without_gathering_recordings(spark):
    rng = random.Random(11)
    for longest, gap, least in ((400, 60, 150), (90, 0, 40), (300, 500, 250)):
        rows = []
        for r in "pq":
            at = 0
            for i in range(150):
                at += rng.choice([0, 0, rng.randrange(longest)])
                rows.append((r, i, rng.choice("AB") if rng.random() < 0.9 else "C", at, at + rng.randrange(longest), rng.choice(["a", " b ", "", " c ", "d e"])))
        got = [tuple(r) for r in folding.smooth_turns(spark.createDataFrame(rows, SEGMENT), gap_ms=gap, least_ms=least).collect()]
        want = []
        for r in "pq":
            mine = [dict(zip(folding.NAMES, x, strict=True)) for x in sorted((x for x in rows if x[0] == r), key=lambda x: (x[3], x[4], x[2], x[1]))]
            want += [tuple(t[n] for n in folding.NAMES) for t in folding.smooth(mine, gap, least)]
        assert len(want) < len(rows) and sorted(got) == sorted(want)


def test_chunk_plan_passes_chunks_on(spark, monkeypatch):
    monkeypatch.setattr(text, "PLAN_CHARS", 25)
    texts = ["one\ntwo three\n" * 9, "", None, "x" * 70]
    got = [tuple(r) for r in text.chunk_plan(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", max_chars=20, overlap_chars=8).collect()]
    assert sorted(got) == [(k, i + 1, len(c), a, b) for k, t in enumerate(texts) for c in [text.chunks(t or "", 20, 8)] for i, (a, b) in enumerate(c)]


def test_language_model_learns_from_every_run(spark, monkeypatch):
    asked = []

    def drawn(blocks, vocabulary, path, share, slices):
        asked.append((share, slices))
        return spark.createDataFrame([], "slice long, windows binary")

    monkeypatch.setattr(lm_scoring, "drawn_windows", drawn)
    monkeypatch.setattr(lm_scoring, "slice_gradients", lambda drawn, model, of: (asked.append(of) or 0, None))
    counts = np.ones(50_258)
    counts[-1] = 1_000_000
    lm_scoring.fit_attention(None, counts, "")
    (share, slices), steps = asked[0], asked[1:]
    assert share == 1.0 and set(steps) == set(range(slices))


def test_reaper_joins_recordings_with_flags_of_their_jobs_alone(spark):
    rng = random.Random(13)
    time = lambda: rng.choice([None, 1, 4, 5, 9])
    jobs = [(i, rng.randrange(40), rng.choice(["queued", "queued", "started", "finished", None]), time(), rng.randrange(9), rng.randrange(9)) for i in range(90)]
    recordings = [(i, rng.choice([*reaper.STALE_FROM, "Ready"]), rng.choice([2, 8, None])) for i in range(36)]
    frames = spark.createDataFrame(jobs, "id long, recording_id long, status string, started_at long, updated_at long, created_at long"), spark.createDataFrame(recordings, "id long, status string, updated_at long")
    out, after = reaper.reap(*frames, F.lit(5))
    late = {j[0] for j in jobs if j[2] == "started" and j[3] is not None and j[3] < 5 and j[1] < 36}
    running = {j[1] for j in jobs if j[2] == "started" and j[0] not in late}
    stale = {r[0] for r in recordings if r[1] in reaper.STALE_FROM and r[0] not in running and any(j[0] in late and j[1] == r[0] for j in jobs)}
    orphans = {r[0] for r in recordings if r[1] in reaper.ORPHAN_FROM and r[2] == 2 and r[0] not in running | stale}
    queued = {max((j for j in jobs if j[1] == k and j[2] == "queued"), key=lambda j: (j[4], j[5], j[0]), default=(None,))[0] for k in orphans} - {None}
    assert orphans and queued and {r["id"] for r in after.where("recovered").collect()} == stale | orphans
    assert {r["id"] for r in out.where("recovered").collect()} == late | queued and after.count() == 36 and out.count() == 90
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
