"""Calendar files, scalar functions, folding of turns, and streams against their batch forms."""

import random
import tempfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from colloquy.functions import scalars
from colloquy.operators import folding, reports
from colloquy.sources import ics
from colloquy.streaming import windows
from tests.conftest import SF

UTC = timezone.utc
ICS = """BEGIN:VCALENDAR
BEGIN:VEVENT
UID:w
DTSTART:20240101T090000Z
DTEND:20240101T093000Z
RRULE:FREQ=WEEKLY;COUNT=6
SUMMARY:Weekly
 ly long
END:VEVENT
BEGIN:VEVENT
UID:b
DTSTART;TZID=Europe/Berlin:20240115T090000
DTEND;TZID=Europe/Berlin:20240115T100000
END:VEVENT
BEGIN:VEVENT
UID:c
STATUS:CANCELLED
DTSTART:20240115T090000Z
END:VEVENT
BEGIN:VEVENT
UID:d
DTSTART;VALUE=DATE:20240116
SUMMARY:first
END:VEVENT
BEGIN:VEVENT
UID:d
DTSTART;VALUE=DATE:20240116
SUMMARY:last
END:VEVENT
END:VCALENDAR
"""


def test_calendar_files(spark):
    df = spark.createDataFrame([(1, ICS), (2, ""), (3, None)], "source_id long, payload string")
    got = ics.expand(df, datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 25, tzinfo=UTC)).orderBy("uid", "starts_ms").collect()
    at = lambda r: datetime.fromtimestamp(r["starts_ms"] / 1000, UTC).strftime("%d %H:%M")
    assert [(r["uid"], at(r)) for r in got] == [("b", "15 08:00"), ("d", "16 00:00"), ("w", "01 09:00"), ("w", "08 09:00"), ("w", "15 09:00"), ("w", "22 09:00")]
    assert got[1]["summary"] == "last" and got[1]["all_day"] and got[2]["summary"] == "Weeklyly long"


def test_scalars(spark):
    df = spark.createDataFrame([("EN-us", "eng", "x1", " Ann <A@x.org> ", "2024-01-31 10_20_30.mp3", "llm_chunk_2_of_5")], "a string, b string, c string, d string, e string, f string")
    row = df.select(
        scalars.language_code(F.col("a")).alias("a"), scalars.language_code(F.col("b")).alias("b"), scalars.language_code(F.col("c")).alias("c"), scalars.participant(F.col("d")).alias("d"),
        scalars.captured_local(F.col("e")).cast("string").alias("e"), scalars.chunk_position(F.col("f")).alias("f"), scalars.clock(F.lit(3661)).alias("g"), scalars.safe_number(F.lit("nan"), 7.0).alias("h"),
        scalars.tone_score(F.lit("101.2")).alias("i"), scalars.slug(F.lit("a b/c")).alias("j"), scalars.joined_text(F.lit("we say"), F.lit("That is")).alias("k"), scalars.joined_text(F.lit("Done."), F.lit("That is")).alias("l"),
        scalars.precheck(F.lit(5.0), F.lit(0.5)).alias("m"), scalars.routing_tokens(F.lit("The A-Team of 2")).alias("n"), scalars.text_items(F.lit("- a\n\n* b")).alias("o"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == ("en", "en", None)
    assert tuple(row["d"]) == ("Ann", "a@x.org") and row["e"] == "2024-01-31 10:20:30" and tuple(row["f"]) == (2, 5)
    assert (row["g"], row["h"], row["i"], row["j"]) == ("01:01:01", 7.0, 100, "a_b_c")
    assert (row["k"], row["l"], row["m"]) == ("we say that is", "Done. That is", "duration_lt_20s")
    assert row["n"] == ["team"] and row["o"] == ["a", "b"]


def turn(s, a, b, t="x"):
    return {"recording_id": "r", "seq": a, "speaker": s, "start_ms": a, "end_ms": b, "text": t}


def test_short_turns_fold_back_then_forward():
    rows = [turn("A", 0, 1000, "one two three four five six"), turn("A", 6000, 7000, "Yes"), turn("B", 7100, 7200, "no"), turn("A", 7300, 9000, "a b c d e f g")]
    got = folding.fold_short(rows, 6, 8000)
    assert [(t["speaker"], t["end_ms"], t["text"]) for t in got] == [("A", 7000, "one two three four five six yes"), ("B", 7200, "no"), ("A", 9000, "a b c d e f g")]
    ahead = folding.fold_short([turn("A", 0, 100, "Ok"), turn("A", 300, 900, "one two three four five six")], 6, 8000)
    assert [(t["start_ms"], t["text"]) for t in ahead] == [(0, "Ok one two three four five six")]


def test_micro_turns_are_absorbed():
    rows = [turn("A", 0, 1000), turn("B", 1100, 1300), turn("A", 1400, 2400), turn("B", 2500, 2700), turn("A", 2800, 4000), turn("B", 4100, 6000)]
    got = folding.smooth(rows, 500, 500)
    assert [(t["speaker"], t["start_ms"], t["end_ms"]) for t in got] == [("A", 0, 4000), ("B", 4100, 6000)]


def test_folding_keeps_all_words(spark):
    rng = random.Random(0)
    rows, at = [], 0
    for _ in range(200):
        at += rng.randint(0, 900)
        rows.append(turn(rng.choice("AB"), at, at + rng.randint(50, 1500), " ".join("w" for _ in range(rng.randint(1, 9)))))
    for out in (folding.fold_short(rows, 6, 800), folding.smooth(rows, 500, 500)):
        assert sum(len(t["text"].split()) for t in out) == sum(len(t["text"].split()) for t in rows) and len(out) < len(rows)


def test_markdown_and_extracts(spark):
    recs = spark.createDataFrame([("r", "a.mp3", "Ready"), ("q", "b.mp3", "Ready")], "id string, source_filename string, status string")
    turns = spark.createDataFrame([("r", 1, "A", 61_000, 62_000, "two"), ("r", 0, "B", 0, 10, "one")], "recording_id string, seq long, speaker string, start_ms long, end_ms long, text string")
    got = {r["recording_id"]: r["markdown"] for r in reports.markdown(recs, turns).collect()}
    assert got["r"].endswith("- [00:00] **B**: one\n- [01:01] **A**: two\n") and "(none)" in got["q"]
    items = spark.createDataFrame([("r", "cue", c, k, t) for c, k, t in [(0, 0, "A b"), (0, 1, "c"), (1, 0, "a  B"), (1, 1, " "), (1, 2, "d")]], "recording_id string, kind string, chunk int, place int, text string")
    assert [r["text"] for r in reports.merge_extracts(items).orderBy("position").collect()] == ["A b", "c", "d"]


@pytest.mark.parametrize("fn", [windows.activity_sessions, windows.tumbling_ratio])
def test_streams_equal_their_batch_forms(spark, fn):
    name = f"t_{fn.__name__}"
    q = fn(windows.event_stream(spark, SF)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = {tuple(r) for r in spark.table(name).collect()}
    batch = {tuple(r) for r in fn(windows.event_batch(spark, SF)).collect()}
    assert streamed and streamed <= batch and len(batch) - len(streamed) < 60  # the last ones are open when the input ends


def test_fixed_values(spark):
    row = spark.range(1).select(
        *[F.coalesce(scalars.language_code(F.lit(c)), F.lit("-")).alias(c) for c in ("kor", "chi", "pol", "eng")],
        scalars.routing_tokens(F.lit("from alpha at beta or is")).alias("tokens"),
        scalars.precheck(F.lit(100.0), F.lit(0.05)).alias("why"),
        F.array(*[scalars.retry_delay(F.lit(t), F.lit(n)) for t, n in (("precheck", 1), ("precheck", 2), ("precheck", 3), ("publish", 1), ("other", 1), ("other", 2), ("other", 0))]).alias("delays"),
    ).first()
    assert (row["kor"], row["chi"], row["pol"], row["eng"]) == ("ko", "zh", "-", "en")
    assert row["tokens"] == ["alpha", "beta"] and row["why"] == "speech_ratio_lt_0.10"
    assert row["delays"] == [1, 2, 0, 3, 2, 0, 0]


def test_speech_is_joined_by_one_rule(spark):
    from colloquy.operators.folding import joined

    cases = [
        ("we say", "That is", "we say that is"), ("Done.", "That is", "Done. That is"), ("see:", "That is", "see: that is"), ("and so…", "That", "and so… that"),
        ("and", "API-based tools", "and API-based tools"), ("and", "Ab c", "and ab c"), ("and", "I think", "and I think"), ("and", "I'm here", "and i'm here"), ("", "Yes", "Yes"), ("a", "", "a"), (" ", "Yes", "Yes"),
    ]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select(scalars.joined_text(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r["j"] for r in rows] == [c for _, _, c in cases] == [joined(a, b) for a, b, _ in cases]


def test_blank_and_null_turns_are_folded(spark):
    from colloquy.operators import folding

    rows = [("r", 0, "A", 0, 1000, None), ("r", 1, "A", 1200, 2000, " "), ("r", 2, "A", 2100, 9000, "one two three four five six seven"), ("r", 3, "B", 9100, 9200, None)]
    turns = spark.createDataFrame(rows, folding.TURN)
    for out in (folding.merge_short_turns(turns), folding.smooth_turns(turns)):
        assert not any("None" in r["text"] for r in out.collect())


def test_root_causes_and_chunks_by_rank(spark):
    from colloquy.operators import reports

    causes = [("a", "recording", "x"), ("a", "stage", "y"), ("a", "chunk", "z"), ("a", "job", "zz"), ("b", "recording", "job_retry_limit_reached"), ("b", "chunk", "processing_runtime_error"), ("c", "stop", "u"), ("c", "recording", "v")]
    got = {r["recording_id"]: r["code"] for r in reports.root_causes(spark.createDataFrame(causes, "recording_id string, source string, code string")).collect()}
    assert got == {"a": "x", "b": "processing_runtime_error", "c": "u"}
    chunks = [("a", "1", "failed", "2024-02-01"), ("a", "2", "running", "2024-01-01"), ("b", "1", "completed", "2024-01-01"), ("b", "2", "split", "2023-01-01"), ("c", "1", "odd", "2024-01-01"), ("c", "2", "odd", "2024-01-02")]
    got = {r["recording_id"]: r["chunk_index"] for r in reports.current_chunks(spark.createDataFrame(chunks, "recording_id string, chunk_index string, status string, updated_at string")).collect()}
    assert got == {"a": "2", "b": "2", "c": "2"}
