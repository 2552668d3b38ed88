"""Literal cases, and models of operators that SQL can't express."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions.intervals import coalesced, islands
from colloquy.operators import calendar, changes, diarization, language, metrics, people, store, text, turns

COLS = "recording_id string, seq long, speaker string, start_ms long, end_ms long, text string"


def segs(spark, rows):
    return spark.createDataFrame([("r", k, s, a, b, t) for k, (a, b, s, t) in enumerate(rows)], COLS)


def model_islands(rows, gap, same):
    out, island, top, last = [], 0, None, object()
    for a, b, s in rows:
        if same and s != last:
            top = None
        if top is None or a > top + gap:
            island, top = island + 1, b
        top, last = max(top, b), s
        out.append(island)
    return out


@pytest.mark.parametrize("same", [(), ("speaker",)])
def test_islands_equal_a_loop_whatever_the_buckets(spark, same):
    rng = random.Random(1)
    rows = sorted((rng.randrange(40_000), 0, rng.choice("AB")) for _ in range(300))
    rows = sorted((a, a + rng.randrange(900), s) for a, _, s in rows)
    df = segs(spark, [(a, b, s, "x") for a, b, s in rows])
    for bucket in (500, 7_000, 10**9):
        got = islands(df, ["recording_id"], turns.ORDER, gap=50, same=list(same), bucket=bucket).orderBy(*turns.ORDER).collect()
        assert [r["island"] for r in got] == model_islands(rows, 50, same)


def test_turns_merge_within_a_gap_of_one_speaker(spark):
    got = turns.merge_turns(segs(spark, [(0, 1000, "S1", "a"), (1600, 2000, "S1", "b"), (2100, 3000, "S2", "c"), (3100, 4000, "S1", "d")])).orderBy("start_ms").collect()
    assert [(r["speaker"], r["end_ms"], r["text"]) for r in got] == [("S1", 2000, "a b"), ("S2", 3000, "c"), ("S1", 4000, "d")]


def test_interruptions_of_a_literal_case(spark):
    got = turns.interruptions(segs(spark, [(0, 5000, "S1", ""), (4600, 6000, "S2", ""), (5800, 7000, "S3", ""), (6500, 8000, "S1", "")])).collect()
    assert {r["speaker"]: (r["interruptions_done"], r["interruptions_received"]) for r in got} == {"S1": (1, 1), "S2": (1, 0), "S3": (0, 1)}


def test_simultaneous_starts_do_not_interrupt(spark):
    got = turns.interruptions(segs(spark, [(0, 2000, "S1", ""), (0, 1500, "S2", ""), (1200, 2500, "S3", "")])).collect()
    assert {r["speaker"]: r["interruptions_done"] for r in got} == {"S1": 0, "S2": 0, "S3": 2}


def test_interval_union(spark):
    got = coalesced(segs(spark, [(0, 10, "S1", ""), (10, 20, "S1", ""), (5, 7, "S1", ""), (30, 30, "S1", ""), (40, 50, "S1", "")]), ["speaker"]).orderBy("start_ms").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in got] == [(0, 20), (40, 50)]


def test_words_take_overlap_first_then_the_nearest_middle(spark):
    words = segs(spark, [(0, 100, "", ""), (900, 1000, "", ""), (5000, 5100, "", "")])
    segments = segs(spark, [(50, 300, "S1", ""), (950, 990, "S2", ""), (960, 2000, "S3", "")])
    got = {r["word"]: r["speaker"] for r in turns.assign_speakers(words, segments).collect()}
    assert got == {0: "S1", 1: "S2", 2: "S3"}
    assert {r["speaker"] for r in turns.assign_speakers(words, segments.where("false")).collect()} == {"S1"}


def test_profile_reasons(spark):
    dialog = [(k * 2000, k * 2000 + 1900, f"S{k % 2}", "") for k in range(30)]
    rows = diarization.classify_profiles(diarization.profile_metrics(segs(spark, dialog)), turn_count=F.lit(30), duration_ms=F.lit(700_000))
    assert rows.first()["reason"] == "dominant_pair_dialog_like"
    short = diarization.classify_profiles(diarization.profile_metrics(segs(spark, dialog)), turn_count=F.lit(3), duration_ms=F.lit(700_000))
    assert short.first()["reason"] == "dialog_like_below_min_turns"


def test_flicker_goes_to_the_nearest_stable_speaker(spark):
    rows = segs(spark, [(0, 10_000, "S1", ""), (10_100, 10_500, "S9", ""), (10_600, 20_000, "S2", ""), (20_050, 20_300, "S9", ""), (30_000, 40_000, "S1", "")])
    got = {r["seq"]: r["speaker"] for r in diarization.relabel_flicker(rows).collect()}
    assert got == {0: "S1", 1: "S1", 2: "S2", 3: "S2", 4: "S1"}
    only = segs(spark, [(0, 100, "S1", ""), (200, 300, "S2", "")])
    assert {r["speaker"] for r in diarization.relabel_flicker(only).collect()} == {"S1", "S2"}


def test_similar_speakers_merge_unless_they_overlap(spark):
    rows = segs(spark, [(0, 5000, "A", ""), (5000, 6000, "B", ""), (4000, 9000, "C", "")])
    near = spark.createDataFrame([("r", "A", "B", 0.9), ("r", "A", "C", 0.95), ("r", "B", "C", 0.6)], "recording_id string, speaker_a string, speaker_b string, similarity double")
    got = {r["speaker"]: r["merged_into"] for r in diarization.merge_similar_speakers(rows, near).collect()}
    assert got == {"A": "A", "B": "A", "C": "C"}


def test_one_to_one_assignment_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"r{r}", f"s{s}", p, round(rng.random(), 2)) for r in range(30) for s in range(4) for p in range(4) if rng.random() < 0.8]
    got = people.assign_one_to_one(spark.createDataFrame(rows, "recording_id string, speaker string, voice_profile_id long, score double"), least=0.3).collect()
    for r in {x[0] for x in rows}:
        score = {(s, p): v for rr, s, p, v in rows if rr == r and v >= 0.3}
        speakers = sorted({s for rr, s, _, _ in rows if rr == r})
        plans = [c for c in itertools.product([None, 0, 1, 2, 3], repeat=len(speakers)) if len({x for x in c if x is not None}) == sum(x is not None for x in c) and all(x is None or (s, x) in score for s, x in zip(speakers, c))]
        best = max(round(sum(score.get((s, x), 0) for s, x in zip(speakers, c)), 6) for c in plans)
        mine = [x for x in got if x["recording_id"] == r and x["voice_profile_id"] is not None]
        assert round(sum(x["confidence"] for x in mine), 6) == best
        assert len({x["voice_profile_id"] for x in mine}) == len(mine)


def test_texts_with_one_opening_are_not_copies(spark, tmp_path):
    from colloquy.plans.registry import queries

    rows = [(3, "Same start. One end.", "s"), (1, "Same start. Another end.", "s"), (2, "same  START. one end.", "s"), (4, "Same start. One end.", "t"), (5, " ", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["first_wins_texts"](spark, str(tmp_path)).collect()
    assert sorted((r["source"], r["doc_id"]) for r in got) == [("s", 1), ("s", 2), ("t", 4)]


def test_assignment_sees_more_than_three_profiles(spark):
    """Four speakers with the same three best profiles: the fourth gets its fourth."""
    known = spark.createDataFrame([(k, [1.0, 0.1 * k]) for k in range(6)] + [(6, [-1.0, 0.0])], "voice_profile_id long, centroid array<double>")
    samples = spark.createDataFrame([(k, k, [1.0, 0.0]) for k in range(4)], "sample_id long, voice_profile_id long, embedding array<double>")
    rows = people.all_candidates(samples, known, least=0.2, block=2)
    assert sorted((r["sample_id"], r["candidate"]) for r in rows.collect()) == [(s, k) for s in range(4) for k in range(6)]
    named = rows.select(F.lit("r").alias("recording_id"), F.concat(F.lit("S"), "sample_id").alias("speaker"), F.col("candidate").alias("voice_profile_id"), "score")
    got = people.assign_one_to_one(named, least=0.2).collect()
    assert sorted(r["voice_profile_id"] for r in got) == [0, 1, 2, 3]


def test_repeated_sentences_go():
    assert text.without_repeats("hello hello hello") == "hello"
    assert text.without_repeats("hi") == ""
    assert text.without_repeats("Hi there. Hi there. New one.") == "Hi there. New one."


def test_subsequence_length_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            row = list(itertools.accumulate(range(len(b) + 1), lambda best, j, row=row, c=c: best if j == 0 else max(best, row[j], row[j - 1] + (b[j - 1] == c)), initial=0))[1:]
        assert text.common_subsequence(a, b) == row[-1]


def test_chunks_keep_all_words_and_sizes():
    words = [f"w{k}" * (1 + k % 4) for k in range(200)]
    body = ". ".join(" ".join(words[i : i + 7]) for i in range(0, 200, 7)) + "\n" + "x" * 95
    plan = text.chunks(body, 40, 10)
    assert all(len(b) <= 40 and len(a) <= 10 for a, b in plan)
    assert "".join("".join(b.split()) for _, b in plan) == "".join(body.split())


def test_glossary_fit_skips_long_terms():
    kept, cut = text.fit_glossary([("alpha", ["a1", "x" * 30]), ("ALPHA", []), ("beta", [])], max_chars=12)
    assert kept == [("alpha", ["a1"]), ("beta", [])] and cut


def test_json_object(spark):
    rows = ["{\"a\":1}", "so: ```json\n{\"a\": 2}\n``` ok", "x {\"a\": 3} y", "none", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(F.get_json_object(text.json_object(F.col("t")), "$.a")).collect()]
    assert got == ["1", "2", "3", None, None]


def test_apportioned_shares_add_up(spark):
    df = spark.createDataFrame([("g", "a", 1, 10), ("g", "b", 1, 10), ("g", "c", 1, 10), ("z", "a", 0, 3), ("z", "b", 0, 3)], "g string, k string, w long, t long")
    got = {(r["g"], r["k"]): r["share"] for r in metrics.apportion(df, ["g"], "t", "w", "k").collect()}
    assert got == {("g", "a"): 3, ("g", "b"): 3, ("g", "c"): 4, ("z", "a"): 2, ("z", "b"): 1}


def test_language_guess_and_cues(spark):
    df = spark.createDataFrame([("the team and you",), ("el equipo de la ñ",), ("and el",), ("",), (None,)], "text string")
    got = [r["language"] for r in df.select(*[c.alias(n) for n, c in language.guess(F.col("text")).items()]).collect()]
    assert got == ["en", "es", None, None, None]
    cues = spark.createDataFrame([("We will decide. owner?",), (None,)], "text string").select(metrics.signals(F.col("text")), metrics.question_marks(F.col("text"))).collect()
    assert [tuple(r) for r in cues] == [(2, 1), (0, 0)]


def test_capture_assessment(spark):
    rows = [(None, "drive", None, None, False), ("2024-01-01 10:00:00", "drive", None, None, False), ("2024-01-01 09:00:00", "drive", "2024-01-01 10:00:00", "Europe/Berlin", True), ("2024-01-01 10:00:00", "drive", "2024-01-01 10:00:00", "Europe/Berlin", True), ("2024-01-01 10:00:00", "upload", None, "UTC", False), ("2024-01-01 10:00:00", "upload", None, None, False)]
    df = spark.createDataFrame(rows, "c string, source string, captured_at_source string, captured_at_timezone string, captured_at_inferred_from_filename boolean").withColumn("captured_at", F.to_timestamp_ntz("c"))
    assert [r["capture_status"] for r in calendar.capture_assessment(df).collect()] == ["missing", "stored_utc", "corrected_local", "suspicious", "weak_upload_time", "suspicious"]


def test_changes(spark):
    base = spark.createDataFrame([(1, "Processing"), (2, "Ready"), (3, "Processing")], "id long, status string")
    busy = spark.createDataFrame([(3,)], "id long")
    got = {r["id"]: (r["status"], r["changed"]) for r in changes.compare_and_set(base, "NeedsReview", ["Processing"], unless=busy).collect()}
    assert got == {1: ("NeedsReview", True), 2: ("Ready", False), 3: ("Processing", False)}
    new = spark.createDataFrame([(2, "Failed"), (9, "Queued")], "id long, status string")
    assert {(r["id"], r["status"]) for r in changes.upsert(base, new, ["id"]).collect()} == {(1, "Processing"), (2, "Failed"), (3, "Processing"), (9, "Queued")}
    with pytest.raises(Exception, match="unknown status"):
        changes.checked(new.withColumn("status", F.lit("odd")), "status", ["Queued"]).collect()
    ids = spark.createDataFrame([([3, 1, 2],)], "x array<long>")
    assert ids.select(changes.rewritten_ids(F.col("x"), 3, 1)).first()[0] == [1, 2]
    cand = spark.createDataFrame([([(1, 0.5), (2, 0.9), (3, 0.7)],)], "x array<struct<voice_profile_id: bigint, score: double>>")
    assert [tuple(c) for c in cand.select(changes.rewritten_candidates(F.col("x"), 2, 1)).first()[0]] == [(1, 0.9), (3, 0.7)]


def test_pages_are_clamped(spark):
    df = spark.range(20)
    assert [r["id"] for r in store.page(df, ["id"], limit=0, offset=-3).collect()] == [0]
    assert store.page_links(20, limit=5, offset=5)["next_offset"] == 10


def test_empty_tables(spark):
    none = segs(spark, [(0, 1, "S1", "x")]).where("false")
    for df in (turns.merged_blocks(none), turns.interruptions(none), diarization.profile_metrics(none), diarization.relabel_flicker(none), language.spans(none.withColumn("language", F.lit("en")))):
        assert df.count() == 0


def test_all_projects_take_part_in_routing(spark, monkeypatch):
    from colloquy.plans import meaning
    from tests.conftest import SF

    seen = []
    monkeypatch.setattr(people, "routing_choice", lambda scores, named: seen.append(named.count()))
    meaning.routing_scores(spark, SF)
    assert seen == [spark.read.parquet(f"{SF}/nation.parquet").count()]
