"""Queries over speaker turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.intervals import coalesced, islands
from colloquy.operators import turns
from colloquy.operators.turns import ORDER, airtime, assign_speakers, interruptions, merged_blocks
from colloquy.plans.sql import BLOCKS, INTERRUPTIONS, SEGMENTS
from colloquy.sources.tables import asr_segments, role_segments, segments

GAP_MS = 60_000


def turns_merge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_blocks(segments(spark, sf_dir), gap_ms=GAP_MS).drop("island")


def interruptions_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interruptions(segments(spark, sf_dir))


def conversation_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airtime, share, turns and interruptions of every speaker of every recording."""
    rows = segments(spark, sf_dir)
    spoken = airtime(merged_blocks(rows, gap_ms=GAP_MS))
    w = Window.partitionBy("recording_id")
    share = F.when(F.sum("airtime_ms").over(w) > 0, F.round(F.col("airtime_ms") / F.sum("airtime_ms").over(w), 4)).otherwise(0.0)
    rank = F.row_number().over(w.orderBy(F.desc("airtime_ms"), "speaker")).cast("long")
    spoken = spoken.withColumns({"airtime_share": share, "position": rank})
    return spoken.join(interruptions(rows), ["recording_id", "speaker"], "left").na.fill(0, ["interruptions_done", "interruptions_received"])


def meeting_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = conversation_participants(spark, sf_dir)
    return people.groupBy("recording_id").agg(
        F.count("*").alias("participants_count"),
        F.sum("airtime_ms").alias("total_speech_ms"),
        F.sum("turns").alias("total_turns"),
        F.sum("interruptions_done").alias("total_interruptions"),
    )


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time in which each speaker speaks, counted once."""
    united = coalesced(segments(spark, sf_dir), ["recording_id", "speaker"])
    return united.groupBy("recording_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("union_ms"), F.count("*").alias("n_intervals"))


def sweep_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of each segment that earlier ones of the recording have covered already."""
    rows = islands(segments(spark, sf_dir), ["recording_id"], ORDER)
    covered = F.greatest(F.lit(0), F.least(F.coalesce("prev_end", F.lit(0)), F.col("end_ms")) - F.col("start_ms"))
    return rows.groupBy("recording_id").agg(F.sum(covered).alias("overlap_ms"))


def word_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of one kind of event as words, the others as segments."""
    rows = segments(spark, sf_dir)
    words = rows.where("text = 'click'").withColumn("end_ms", F.col("start_ms") + 200)
    return assign_speakers(words, rows.where("text <> 'click'"))


def word_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations, 400 ms apart, spoken over shorter segments of their roles."""
    return turns.word_turns(asr_segments(spark, sf_dir), role_segments(spark, sf_dir), default_language="en")


_HEAD = f"WITH {SEGMENTS}, {BLOCKS}"
_PEOPLE = f"""{_HEAD}, {INTERRUPTIONS}, air AS (
  SELECT recording_id, speaker, sum(greatest(0, end_ms - start_ms))::BIGINT AS airtime_ms, count(*) AS turns FROM blocks GROUP BY 1, 2
), people AS (
  SELECT a.*, CASE WHEN sum(airtime_ms) OVER (PARTITION BY recording_id) > 0 THEN round(airtime_ms / (sum(airtime_ms) OVER (PARTITION BY recording_id))::DOUBLE, 4) ELSE 0.0 END AS airtime_share,
    row_number() OVER (PARTITION BY recording_id ORDER BY airtime_ms DESC, speaker) AS position,
    coalesce(interruptions_done, 0)::BIGINT AS interruptions_done, coalesce(interruptions_received, 0)::BIGINT AS interruptions_received
  FROM air a LEFT JOIN ints USING (recording_id, speaker)
)"""
_WORDS = f"""WITH {SEGMENTS}, w AS (
  SELECT recording_id, seq AS word, start_ms AS ws, start_ms + 200 AS we FROM seg WHERE text = 'click'
), s AS (
  SELECT * FROM seg WHERE text <> 'click'
), o AS (
  SELECT w.recording_id, word, speaker, s.seq, row_number() OVER (PARTITION BY w.recording_id, word ORDER BY least(we, end_ms) - greatest(ws, start_ms) DESC, start_ms, end_ms, speaker, s.seq) AS r
  FROM w JOIN s ON w.recording_id = s.recording_id AND s.start_ms < we AND s.end_ms > ws
), lone AS (
  SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.word = w.word)
), n AS (
  SELECT l.recording_id, word, speaker, s.seq, row_number() OVER (PARTITION BY l.recording_id, word ORDER BY greatest(0, 2 * start_ms - ws - we, ws + we - 2 * end_ms), start_ms, end_ms, speaker, s.seq) AS r
  FROM lone l JOIN s USING (recording_id)
), best AS (
  SELECT * FROM o WHERE r = 1 UNION ALL SELECT * FROM n WHERE r = 1
)
SELECT w.recording_id, w.word, coalesce(b.speaker, 'S1') AS speaker, b.seq AS segment_seq FROM w LEFT JOIN best b ON w.recording_id = b.recording_id AND w.word = b.word"""

_TURNS = r"""WITH t AS (
  SELECT conv_id::VARCHAR AS recording_id, turn AS segment, turn * 5000 AS began, coalesce(role, 'S1') AS role,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM conversations
), seg AS (
  SELECT recording_id, segment, role AS speaker, began + 700 AS s, began + 4000 AS e FROM t
), w AS (
  SELECT recording_id, segment, place - 1 AS place, began + 400 * (place - 1) AS ws, began + 400 * (place - 1) + 350 AS we, ws[place] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS place FROM t)
), o AS (
  SELECT w.*, greatest(0, least(we, e) - greatest(ws, s)) AS shared, greatest(0, 2 * s - ws - we, ws + we - 2 * e) AS far, s, e, speaker, seg.segment AS q FROM w JOIN seg ON w.recording_id = seg.recording_id
), p AS (
  SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY recording_id, segment, place ORDER BY shared DESC, far, s, e, speaker, q) = 1
), c AS (
  SELECT *, (speaker IS DISTINCT FROM lag(speaker) OVER v)::INT AS changed FROM p WINDOW v AS (PARTITION BY recording_id ORDER BY ws, we, word, segment, place)
), r AS (
  SELECT *, sum(changed) OVER (PARTITION BY recording_id ORDER BY ws, we, word, segment, place ROWS UNBOUNDED PRECEDING) AS run FROM c
), b AS (
  SELECT *, max(we) OVER (PARTITION BY recording_id, run ORDER BY ws, we, word, segment, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r
), i AS (
  SELECT *, sum((top IS NULL OR ws > top + 1000)::INT) OVER (PARTITION BY recording_id ORDER BY ws, we, word, segment, place ROWS UNBOUNDED PRECEDING) AS island FROM b
), l AS (
  SELECT *, lag(word) OVER (PARTITION BY recording_id, island ORDER BY ws, we, word, segment, place) AS prior FROM i
), j AS (
  SELECT *, CASE WHEN prior IS NULL OR place > 0 OR regexp_matches(prior, '[.!?]$') OR NOT regexp_matches(word, '^\p{Lu}') OR word = 'I' OR regexp_matches(word, '^\p{Lu}{2,}(\P{L}|$)')
    THEN word ELSE lower(word[1]) || word[2:] END AS piece FROM l
)
SELECT recording_id, min(ws) AS start_ms, max(we) AS end_ms, any_value(speaker) AS speaker, string_agg(piece, ' ' ORDER BY ws, we, word, segment, place) AS text, 'en' AS language, count(*) AS n_words
FROM j GROUP BY recording_id, island"""

QUERIES = {
    "turns_merge_gap": (turns_merge_gap, f"{_HEAD} SELECT recording_id, speaker, start_ms, end_ms, n_turns FROM blocks"),
    "interruptions_by_speaker": (interruptions_by_speaker, f"WITH {SEGMENTS}, {INTERRUPTIONS} SELECT * FROM ints"),
    "conversation_participants": (conversation_participants, f"{_PEOPLE} SELECT * FROM people"),
    "meeting_totals": (
        meeting_totals,
        f"{_PEOPLE} SELECT recording_id, count(*) AS participants_count, sum(airtime_ms)::BIGINT AS total_speech_ms, sum(turns)::BIGINT AS total_turns, sum(interruptions_done)::BIGINT AS total_interruptions FROM people GROUP BY 1",
    ),
    "interval_union": (
        interval_union,
        f"""WITH {SEGMENTS}, p AS (
  SELECT *, max(end_ms) OVER (PARTITION BY recording_id, speaker ORDER BY start_ms, end_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM seg WHERE end_ms > start_ms
), i AS (
  SELECT *, sum((pe IS NULL OR start_ms > pe)::INT) OVER (PARTITION BY recording_id, speaker ORDER BY start_ms, end_ms, seq ROWS UNBOUNDED PRECEDING) AS k FROM p
), u AS (
  SELECT recording_id, speaker, k, min(start_ms) AS s, max(end_ms) AS e FROM i GROUP BY 1, 2, 3
) SELECT recording_id, speaker, sum(e - s)::BIGINT AS union_ms, count(*) AS n_intervals FROM u GROUP BY 1, 2""",
    ),
    "sweep_overlap": (
        sweep_overlap,
        f"""WITH {SEGMENTS}, p AS (
  SELECT *, max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM seg
) SELECT recording_id, sum(greatest(0, least(coalesce(pe, 0), end_ms) - start_ms))::BIGINT AS overlap_ms FROM p GROUP BY 1""",
    ),
    "word_speakers": (word_speakers, _WORDS),
    "word_turns": (word_turns, _TURNS),
}
