"""Chunk states and splits, claims, cascades and merges, by literal cases and plain loops."""

import random
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from colloquy.operators import cascades, chunks, claims
from colloquy.operators import text as texts
from colloquy.streaming.reaper import STORE
from tests.test_stateful_streams import files, stream

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def made_marks():
    draw = random.Random(3)
    out = []
    for k in range(60):
        status = draw.choice(["running", "running", "completed", "failed", "split"])
        out.append((draw.choice("rq"), "Extract ", draw.choice("12"), k, T0 + timedelta(minutes=k), status, draw.choice([None, "bad", " "]), draw.choice([None, "1"]), draw.choice([None, "h1", "h2"])))
    return out


def by_loop(states, marks):
    held = {(s[0], s[1].strip().lower(), s[2]): list(s[3:]) for s in states}
    for r, g, i, _, at, status, error, parent, kept in marks:
        row = held.setdefault((r, g.strip().lower(), i), [None, 0, None, None, None, None, None])
        row[0] = status
        if status == "running":
            row[1], row[2], row[3], row[4] = row[1] + 1, at, None, None
        else:
            row[1], row[2], row[3], row[4] = max(row[1], 1), row[2] or at, at, (error or "").strip() or None
        row[5], row[6] = parent or row[5], kept or row[6]
    return {k: tuple(v) for k, v in held.items()}


def as_dict(rows):
    utc = lambda x: x.replace(tzinfo=timezone.utc) if isinstance(x, datetime) else x
    return {tuple(r)[:3]: tuple(utc(x) for x in tuple(r)[3:]) for r in rows}


def test_chunk_states_equal_a_loop(spark):
    states = [("r", "extract", "1", "planned", 0, None, None, None, "p", "old"), ("q", "extract", "2", "failed", 4, T0, T0, "e", None, None), ("z", "extract", "9", "split", 1, T0, T0, None, None, "h")]
    got = chunks.after_marks(spark.createDataFrame(states, chunks.STATES), spark.createDataFrame(made_marks(), chunks.MARKS))
    assert as_dict(got.collect()) == by_loop(states, made_marks())
    with pytest.raises(Exception, match="unknown chunk status"):
        chunks.keyed(spark.createDataFrame([("r", "g", "1", 1, T0, "odd", None, None, None)], chunks.MARKS)).collect()


def test_chunk_states_as_a_stream(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, STORE)
    marks = made_marks()
    at = files(spark, marks, chunks.MARKS, [range(0, 20), range(20, 21), range(21, 60)])
    q = chunks.states_stream(stream(spark, at, chunks.MARKS)).writeStream.format("memory").queryName("chunk_states").outputMode("update")
    q.option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start().awaitTermination(180)
    spark.conf.unset(name)
    got = as_dict(spark.table("chunk_states").collect())  # a later batch's row of a chunk replaces the earlier one's
    want = by_loop([], marks)
    assert got.keys() == want.keys()
    seen = {}
    for r in spark.table("chunk_states").collect():
        seen.setdefault(tuple(r)[:3], []).append(as_dict([r])[tuple(r)[:3]])
    assert all(want[k] in rows for k, rows in seen.items())


def test_only_whole_and_current_chunks_are_resumed(spark):
    row = lambda r, i, status, path, h="h", text="t": (r, i, status, path, h, "h", text, "b")
    rows = [row("a", "1", "completed", [1]), row("a", "10", "planned", [10]), row("a", "2", "split", [2]), row("a", "2b", "failed", [2, 2]), row("a", "2a", "planned", [2, 1]), row("b", "1", "planned", [1]), row("b", "2", "split", [2], "old"), row("c", "1", "planned", [0]), row("d", "1", "planned", [1], text=" "), row("e", "1", "split", [1])]
    df = spark.createDataFrame(rows, "recording_id string, chunk_index string, status string, order_path array<long>, transcript_hash string, current_hash string, text string, base_text string")
    assert [(r["recording_id"], r["chunk_index"]) for r in chunks.resumable(df).orderBy("recording_id", "position").collect()] == [("a", "1"), ("a", "2a"), ("a", "2b"), ("a", "10")]


def recursive(index, path, text, start, end, depth, least):
    cut = chunks.halves(text, least) if depth < 2 else None
    if cut is None:
        return [(index, path, text, start, end)]
    a, b = cut
    middle = None if start is None or end is None else start + int((end - start) * len(a) / (len(a) + len(b)) + 0.5)
    return recursive(index + "a", [*path, 1], a, start, middle, depth + 1, least) + recursive(index + "b", [*path, 2], b, middle, end, depth + 1, least)


def test_slow_chunks_are_split_as_by_recursion(spark):
    draw = random.Random(2)
    line = lambda: " ".join(draw.choice(["alpha", "be", "gamma."]) for _ in range(draw.randrange(1, 30)))
    rows = [("r", str(k), [k], "\n".join(line() for _ in range(draw.randrange(1, 14))), 0, 1000 * k) for k in range(12)] + [("r", "50", [50], "word " * 300, 0, 90_000), ("r", "60", [60], "", 0, 5)]
    df = spark.createDataFrame(rows, "recording_id string, chunk_index string, order_path array<int>, base_text string, start_ms long, end_ms long")
    got = chunks.split_chunks(df, F.lit(True), least_chars=120).collect()
    want = [x for _, i, p, t, a, b in rows for x in recursive(i, p, t, a, b, 0, 120)]
    assert sorted((r["chunk_index"], r["order_path"], r["base_text"].strip(), r["start_ms"], r["end_ms"]) for r in got) == sorted((i, p, t.strip(), a, b) for i, p, t, a, b in want)
    assert any(r["depth"] == 2 and r["parent"][-1] in "ab" for r in got)
    assert chunks.split_chunks(df, F.lit(False)).count() == len(rows)


def test_best_split_is_the_first_of_the_nearest(spark):
    for sizes in ([5], [1, 1, 1, 1], [9, 1, 1], [0, 0], [2, 3, 5, 1], [1, 8, 1]):
        rows = spark.createDataFrame([("g", k, n) for k, n in enumerate(sizes)], "g string, k int, n long")
        total, best = sum(sizes), (sum(sizes), 1)
        for k in range(1, len(sizes)):
            best = min(best, (abs(total - 2 * sum(sizes[:k])), k))
        assert chunks.best_split(rows, ["g"], order="k", size="n").first()["split"] == (best[1] if len(sizes) > 1 else 0)
    assert texts.chunks("", 5, 0) == []


def test_the_first_range_claims_a_segment(spark):
    segments = spark.createDataFrame([("r", k, a, b) for k, (a, b) in enumerate([(0, 10), (10, 20), (15, 15), (20, 20), (30, 25), (5, 40), (50, None)])], "recording_id string, seq long, start_ms long, end_ms long")
    ranges = spark.createDataFrame([("r", 2, 0, 12), ("r", 1, 10, 20), ("r", 3, 24, 45), ("q", 0, 0, 99)], "recording_id string, place long, start_ms long, end_ms long")
    for bucket in (7, 10**6):
        assert {r["seq"]: r["place"] for r in claims.claimed(segments, ranges, bucket=bucket).collect()} == {0: 2, 1: 1, 2: 1, 4: 3, 5: 1}


def test_segments_move_to_the_recording(spark):
    kind = "recording_id string, place long, seq long, start_ms long, end_ms long, words array<struct<start_ms: long, end_ms: long, word: string>>, language string"
    segments = spark.createDataFrame([("r", 1, 0, None, 5, [(1, None, "a")], None), ("r", 2, 1, 10, 4, None, "de")], kind)
    parts = spark.createDataFrame([("r", 1, 100, "en", 0.87654, "en", False, True), ("r", 2, 200, "es", None, None, True, False)], "recording_id string, place long, offset_ms long, chunk_language string, confidence double, hint string, uncertain boolean, conflict boolean")
    a, b = claims.in_recording(segments, parts).orderBy("seq").collect()
    assert (a["start_ms"], a["end_ms"], a["words"][0][:2], a["language"], a["language_confidence"], a["language_source"], a["uncertain"]) == (100, 105, (101, None), "en", 0.8765, "chunk_hint", True)
    assert (b["start_ms"], b["end_ms"], b["words"], b["language"], b["language_source"], b["hint_applied"]) == (210, 210, None, "de", "chunk_detected", False)


def test_deletes_follow_the_graph(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {
        "projects": make([(1,), (2,)], "id long"), "recordings": make([("a", 1, 2), ("b", 2, None)], "id string, project_id long, suggested_project_id long"),
        "jobs": make([(1, "a"), (2, "b"), (3, None)], "id long, recording_id string"), "samples": make([(1, "a", 7), (2, "b", 8)], "id long, recording_id string, voice_profile_id long"),
        "profiles": make([(7,), (8,)], "id long"), "other": make([(1,)], "x long"),
    }
    out = cascades.deleted(tables, "recordings", make([("a",)], "id string"))
    rows = {n: sorted(map(tuple, t.collect()), key=repr) for n, t in out.items()}
    assert rows["recordings"] == [("b", 2, None)] and rows["jobs"] == [(2, "b"), (3, None)] and rows["samples"] == [(1, None, 7), (2, "b", 8)] and rows["other"] == [(1,)]
    out = cascades.deleted(tables, "projects", make([(2,)], "id long"))
    assert sorted(map(tuple, out["recordings"].collect())) == [("a", 1, None), ("b", None, None)]
    out = cascades.deleted(tables, "profiles", make([(8,)], "id long"))
    assert [r["id"] for r in out["samples"].collect()] == [1] and out["profiles"].count() == 1
    chain = (cascades.ForeignKey("recordings", "project_id", "projects"), cascades.ForeignKey("jobs", "recording_id", "recordings"))
    out = cascades.deleted(tables, "projects", make([(1,)], "id long"), graph=chain)
    assert out["recordings"].count() == 1 and sorted(r["id"] for r in out["jobs"].collect()) == [2, 3]
    ring = (*chain, cascades.ForeignKey("recordings", "id", "jobs", key="id"))
    with pytest.raises(ValueError, match="leads back"):
        cascades.deleted(tables, "projects", make([(1,)], "id long"), graph=ring)


def test_merged_profiles_in_all_tables(spark):
    tables = {
        "participants": spark.createDataFrame([("r", [1, 2, 3]), ("r", [1, 2, 3]), ("q", [3]), ("p", []), ("o", None)], "recording_id string, voice_profile_ids array<long>"),
        "weights": spark.createDataFrame([(1, "voice:1", 2), (1, "voice:2", 3), (1, "word", 5), (2, "voice:1", 1)], "project_id long, keyword string, weight long"),
        "profiles": spark.createDataFrame([(1,), (2,), (3,)], "id long"),
        "samples": spark.createDataFrame([(1, 1), (2, None)], "id long, voice_profile_id long"),
    }
    out = cascades.merged_profiles(tables, spark.createDataFrame([(1, 2)], "source long, target long"))
    assert sorted((r[0], r[1]) for r in out["participants"].collect()) == [("o", []), ("p", []), ("q", [3]), ("r", [2, 3]), ("r", [2, 3])]
    assert sorted(map(tuple, out["weights"].collect())) == [(1, "voice:2", 5), (1, "word", 5), (2, "voice:2", 1)]
    assert {r["id"]: r["merged_into"] for r in out["profiles"].collect()} == {1: 2, 2: None, 3: None}
    assert {r["id"]: r["voice_profile_id"] for r in out["samples"].collect()} == {1: 2, 2: None}


def test_speakers_get_one_vector(spark):
    from colloquy.operators import voices

    rows = [("r", k, s, a, b, "") for k, (s, a, b) in enumerate([("A", 0, 10_000), ("A", 20_000, 21_000), ("A", 30_000, 31_000), ("B", 0, 500), ("B", 5, 5), ("", 0, 9000), (None, 0, 9000), ("C", 0, 100), ("A", 40_000, 40_900), ("A", 50_000, 50_800), ("A", 60_000, 60_700)])]
    df = spark.createDataFrame(rows, "recording_id string, seq long, speaker string, start_ms long, end_ms long, text string")
    crops = voices.longest_crops(df)
    assert sorted((r["speaker"], r["place"], r["start_ms"], r["end_ms"]) for r in crops.collect()) == [
        ("A", 1, 3500, 6500), ("A", 2, 20_000, 21_000), ("A", 3, 30_000, 31_000), ("A", 4, 40_000, 40_900), ("A", 5, 50_000, 50_800), ("B", 1, 0, 500), ("C", 1, 0, 100)]

    def load():
        def model(recording, start, end):
            if end == 100:
                raise ValueError("no speech")
            return {3500: [[1.0, 2.0], [3.0, 4.0]], 20_000: [[9.0]], 30_000: [[float("nan"), 1.0]], 40_000: [[4.0, 5.0], [1.0]], 50_000: [[6.0, 7.0]]}.get(start, [])

        return model

    got = voices.speaker_vectors(voices.embedded(crops, load)).collect()
    assert [(r["speaker"], r["crops"], r["vector"]) for r in got] == [("A", 2, [4.0, 5.0])]


def test_backfills(spark):
    from colloquy.operators import backfills

    profiles = spark.createDataFrame([(1, None, None), (2, "b", None), (3, None, "z")], "id long, created_at string, updated_at string")
    samples = spark.createDataFrame([(1, "d"), (1, "c"), (2, "a")], "voice_profile_id long, created_at string")
    assert sorted(map(tuple, backfills.dated_profiles(profiles, samples).collect())) == [(1, "c", "c"), (2, "b", "b"), (3, backfills.NEVER, "z")]
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    kind = "id long, recording_id string, type string, status string, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz"
    jobs = spark.createDataFrame([(1, "r", "stt", "queued", at(30), None, None), (2, "r", "stt", "queued", at(30.5), None, None), (3, "r", "precheck", "queued", at(0), None, None), (4, "r", "llm", "queued", at(-1), None, None), (5, "r", "llm", "queued", at(1), at(2), None), (6, "q", "llm", "queued", at(1), None, None), (7, "r", "align", "started", at(0), None, None)], kind)
    made = spark.createDataFrame([("r", at(0))], "id string, created_at timestamp_ntz")
    assert sorted(r["id"] for r in backfills.without_placeholders(jobs, made).collect()) == [2, 3, 4, 5, 6, 7]
    rows = backfills.dated_assignments(spark.createDataFrame([("r",), ("q",)], "recording_id string"), made.withColumnRenamed("created_at", "updated_at"))
    assert {r["recording_id"]: r["updated_at"] for r in rows.collect()} == {"r": at(0), "q": datetime(1970, 1, 1)}
