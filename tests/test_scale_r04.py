"""Findings of round 4: steps whose work grew faster than their input."""

import random

from colloquy.functions.asof import holding
from colloquy.functions.intervals import islands
from colloquy.operators import calendar, turns

CAPTURE, EVENT = "recording_id long, captured_ms long, duration_sec double", "event_id string, starts_ms long, ends_ms long"


def test_summaries_of_distinct_times_meet_few_pairs(spark, monkeypatch):
    """As all pairs give, with lengths and distances at the limits of closeness; only recordings beyond them meet all their candidates."""
    rng = random.Random(14)
    odd = [None, 0.0, 0.5, 60.0, 300.0, 5000.0, 10797.74, 10797.76, 12000.0, -4.0]
    captures = [(i, rng.randrange(30 * calendar.HOUR), odd[i // 3 % 10] if i % 3 == 0 else round(rng.expovariate(1 / rng.choice([5, 50, 400])), 2)) for i in range(150)]
    events = []
    for _ in range(600):
        events.append((s := rng.randrange(30 * calendar.HOUR), s + rng.choice([0, -5, 1, rng.randrange(90_000), int(rng.expovariate(1e-6)), rng.randrange(30_000_000)])))
    for _, c, sec in captures[::5]:  # that touch a recording, or lie at the limits around it
        over, d = c + int((sec or 0) * 1000), calendar.SCORED_WITHIN[sec is not None] + rng.randrange(-1, 3)
        events += [(c - 40_000, c), (over, over + 9), (c + d, c + d + 500), (c - d, c + rng.choice([-1, 0, 1])), (c - calendar.BEFORE_MS - 50, c - calendar.BEFORE_MS + 1), (c + calendar.AFTER_MS - 1, c + calendar.AFTER_MS)]
    captures = spark.createDataFrame([*captures, (998, None, 5.0), (999, 10**12, 5.0)], CAPTURE)
    events = spark.createDataFrame([(f"e{k}", *e) for k, e in enumerate(events)], EVENT)
    pairs = calendar.candidates(captures, events).collect()
    met, plain = [], calendar.candidates

    def counting(asked, offered):
        frame = plain(asked, offered)
        met.append(frame.count())
        return frame

    monkeypatch.setattr(calendar, "candidates", counting)
    got = sorted(tuple(r) for r in calendar.summaries(captures, events).collect())
    of = {k: [r["score"] for r in pairs if r["recording_id"] == k] for k in {r["recording_id"] for r in pairs}}
    assert got == sorted((k, len(s), sum(x > 0 for x in s), max(s)) for k, s in of.items()) and len(got) == 150
    assert sum(met) < len(pairs) / 5  # all of them before


def test_summaries_with_penalties_and_text_scores(spark):
    rng = random.Random(15)
    captures = spark.createDataFrame([(i, rng.randrange(10**7), 60.0, [0.0, 0.18][i % 2], [0.0, 0.5, None][i % 3]) for i in range(18)], f"{CAPTURE}, penalty double, text_score double")
    events = spark.createDataFrame([(f"e{i}", s, s + rng.randrange(1, 10**6)) for i, s in enumerate(rng.randrange(10**7) for _ in range(30))], EVENT)
    pairs = calendar.candidates(captures, events).collect()
    of = {k: [r["score"] for r in pairs if r["recording_id"] == k] for k in range(18)}
    assert sorted(tuple(r) for r in calendar.summaries(captures, events).collect()) == sorted((k, len(s), sum(x > 0 for x in s), max(s)) for k, s in of.items())


def test_spans_that_hold_a_point(spark):
    rng = random.Random(16)
    spans = [(rng.choice("gh"), s, s + rng.randrange(40), rng.randrange(1, 4)) for s in (rng.randrange(-50, 100) for _ in range(60))]
    points = spark.createDataFrame([(g, k) for g in "ghi" for k in range(-60, 150)], "g string, at long")
    got = {(r["g"], r["at"]): r["n"] for r in holding(points, spark.createDataFrame(spans, "g string, low long, high long, n long"), ["g"], at="at", out="n").collect()}
    assert got == {(g, k): sum(n for h, low, high, n in spans if g == h and low <= k <= high) for g in "ghi" for k in range(-60, 150)}


def _speech(spark):
    """Segments whose long ones run into the next, with capitals at their starts, over many hours."""
    rng = random.Random(17)
    asr = [("xyz"[k % 3], k, 1_700_000 * (k // 3), 1_700_000 * (k // 3) + 900_000, rng.choice(["Well. Yes", "So we go", "NASA flew", "I said", "Then stop."]), [(1_700_000 * (k // 3) + 400 * i, 1_700_000 * (k // 3) + 400 * i + 350 + rng.choice([0, 2_000_000]), w) for i, w in enumerate(rng.choice(["Well. Yes", "So we Go", "NASA flew", "I said", "Then stop."]).split())], rng.choice([None, "EN-us", "deu"])) for k in range(60)]
    said = [("xyz"[k % 3], k, "AB"[k // 12 % 2], 1_700_000 * (k // 3), 1_700_000 * (k // 3) + 800_000, "t") for k in range(60)]
    return spark.createDataFrame(asr, f"recording_id string, seq long, start_ms long, end_ms long, text string, words {turns.WORDS}, language string"), spark.createDataFrame(said, "recording_id string, seq long, speaker string, start_ms long, end_ms long, text string")


def test_parts_of_turns_are_joined_over_buckets(spark):
    want, *got = (sorted(tuple(r) for r in turns.word_turns(*_speech(spark), gap_ms=10**9, bucket=b).collect()) for b in (10**12, 1_000_000, 300))
    assert len(want) < 40 and got == [want, want]


def test_word_turns_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum(b.isShuffle() for b in (blocks.getAllBlocks().apply(k) for k in range(blocks.getAllBlocks().size())))
    before = shuffles()
    asked = turns.word_turns(*_speech(spark))
    assert shuffles() <= before  # all but the last step's, which run when the rows are asked for
    assert asked.count()


def test_islands_deal_rows_once(spark):
    """Rows are shuffled for the summaries and for themselves, and stay in place for all windows and joins; null groups count as one."""
    rng = random.Random(18)
    rows = [(rng.choice(["g", "h", None]), i, s, s + rng.randrange(900), rng.choice("AB")) for i, s in enumerate(rng.randrange(20_000) for _ in range(120))]
    df = spark.createDataFrame(rows, "g string, id long, start_ms long, end_ms long, who string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = islands(df, ["g"], ["start_ms", "end_ms", "who", "id"], gap=50, same=["who"], bucket=1000)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: (r["prev_end"], r["island"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for g in ("g", "h", None):
        end, who, island = None, None, 0
        for _, i, s, e, w in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[3], r[4], r[1])):
            end = end if w == who else None
            island += end is None or s > end + 50
            assert got[i] == (end, island)
            end, who = max(e, end or 0), w
    assert "Exchange hashpartitioning(coalesce" not in plan  # rows dealt anew by each nullable column
