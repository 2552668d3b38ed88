"""Queries over diarization quality and voice snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.diarization import (
    choose_retry,
    classify_profiles,
    max_runs,
    merge_similar_speakers,
    overlap_ratios,
    profile_metrics,
    relabel_flicker,
    speakers_overlap,
)
from colloquy.operators.snippets import rank_snippets, status_counts
from colloquy.plans.sql import SEGMENTS
from colloquy.sources.tables import segments


def diar_profile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_metrics(segments(spark, sf_dir))


def diar_profile_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = profile_metrics(segments(spark, sf_dir))
    rows = classify_profiles(metrics, turn_count=F.col("dominant_turns"), duration_ms=F.col("total_ms"))
    return rows.select("recording_id", "profile", "reason", "dialog_score")


def diar_retry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass over everything against one over longer segments alone."""
    rows = segments(spark, sf_dir)
    passes = [classify_profiles(profile_metrics(x), turn_count=F.col("dominant_turns"), duration_ms=F.col("total_ms")) for x in (rows, rows.where("end_ms - start_ms >= 60000"))]
    return choose_retry(*passes)


def speaker_max_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_runs(segments(spark, sf_dir))


def flicker_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With wide limits, so that quiet speakers of a day count as flicker."""
    return relabel_flicker(segments(spark, sf_dir), min_total_ms=3_200_000, max_run=3).select("recording_id", "seq", "speaker", "flicker")


def speakers_overlap_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers_overlap(segments(spark, sf_dir))


def speaker_overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_ratios(segments(spark, sf_dir))


def snippet_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_snippets(segments(spark, sf_dir))


def snippet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts(rank_snippets(segments(spark, sf_dir)))


def speaker_merge_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity here is what speakers' totals have in common, as the table holds no voices."""
    rows = segments(spark, sf_dir)
    totals = rows.groupBy("recording_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("t"))
    a, b = totals.alias("a"), totals.alias("b")
    pairs = a.join(b, (F.col("a.recording_id") == F.col("b.recording_id")) & (F.col("a.speaker") < F.col("b.speaker")))
    similar = (F.least("a.t", "b.t") / F.greatest("a.t", "b.t")).alias("similarity")
    pairs = pairs.select("a.recording_id", F.col("a.speaker").alias("speaker_a"), F.col("b.speaker").alias("speaker_b"), similar)
    return merge_similar_speakers(rows, pairs, max_overlap=0.06)


_TOTALS = """tot AS (
  SELECT recording_id, speaker, sum(greatest(0, end_ms - start_ms))::BIGINT AS total_ms FROM seg GROUP BY 1, 2
)"""


def _profile(name: str, source: str) -> str:
    return f"""{name}_t AS (
  SELECT recording_id, speaker, sum(end_ms - start_ms)::BIGINT AS total_ms, row_number() OVER (PARTITION BY recording_id ORDER BY sum(end_ms - start_ms) DESC, speaker) AS p,
    sum(sum(end_ms - start_ms)) OVER (PARTITION BY recording_id) AS whole FROM {source} GROUP BY 1, 2
), {name}_s AS (
  SELECT recording_id, count(*) AS speaker_count, sum(total_ms)::BIGINT AS total_ms, sum(total_ms) FILTER (p <= 2) AS top_two,
    count(*) FILTER (p > 2 AND round(total_ms / whole::DOUBLE, 4) <= 0.12) AS low_mass_speakers, coalesce(sum(total_ms) FILTER (p > 2 AND round(total_ms / whole::DOUBLE, 4) <= 0.12), 0)::BIGINT AS low_mass_ms
  FROM {name}_t GROUP BY 1
), {name}_d AS (
  SELECT recording_id, count(*) AS dominant_turns, sum(ch)::BIGINT AS alternations FROM (
    SELECT s.recording_id, (lag(s.speaker) OVER (PARTITION BY s.recording_id ORDER BY start_ms, end_ms, s.speaker, seq) <> s.speaker)::INT AS ch
    FROM {source} s JOIN {name}_t t ON s.recording_id = t.recording_id AND s.speaker = t.speaker AND t.p <= 2) GROUP BY 1
), {name}_o AS (
  SELECT recording_id, sum(greatest(0, least(coalesce(pe, 0), end_ms) - start_ms))::BIGINT AS overlap_ms FROM (
    SELECT *, max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {source}) GROUP BY 1
), {name} AS (
  SELECT recording_id, speaker_count, total_ms, low_mass_speakers, low_mass_ms, dominant_turns, overlap_ms, round(top_two / total_ms::DOUBLE, 4) AS top_two_coverage,
    round(low_mass_ms / total_ms::DOUBLE, 4) AS low_mass_coverage, round(coalesce(alternations, 0) / greatest(dominant_turns - 1, 1)::DOUBLE, 4) AS alternation_ratio, round(overlap_ms / total_ms::DOUBLE, 4) AS overlap_ratio
  FROM {name}_s JOIN {name}_d USING (recording_id) JOIN {name}_o USING (recording_id)
), {name}_l AS (
  SELECT *, speaker_count BETWEEN 2 AND 4 AND top_two_coverage >= 0.85 AND low_mass_speakers >= greatest(speaker_count - 2, 0) AND low_mass_coverage <= 0.12 AND dominant_turns >= 3
      AND alternation_ratio >= 0.55 AND overlap_ratio <= 0.2 AS lk, dominant_turns >= 20 AS et, total_ms >= 600000 AS ed FROM {name}
), {name}_c AS (
  SELECT recording_id, speaker_count, dominant_turns, top_two_coverage, CASE WHEN (lk OR speaker_count = 1) AND et AND ed THEN 'dialog' ELSE 'meeting' END AS profile,
    CASE WHEN speaker_count = 1 AND et AND ed THEN 'single_speaker_long_recording' WHEN lk AND et AND ed THEN 'dominant_pair_dialog_like' WHEN speaker_count = 0 THEN 'no_valid_speakers'
      WHEN speaker_count = 1 THEN 'single_speaker_short_recording' WHEN lk AND NOT et THEN 'dialog_like_below_min_turns' WHEN lk AND NOT ed THEN 'dialog_like_below_min_duration'
      WHEN speaker_count > 4 THEN 'too_many_speakers' WHEN low_mass_speakers < greatest(speaker_count - 2, 0) THEN 'non_tiny_extra_speakers' WHEN top_two_coverage < 0.85 THEN 'low_top_two_coverage'
      WHEN low_mass_coverage > 0.12 THEN 'too_much_low_mass_speech' WHEN dominant_turns < 3 THEN 'insufficient_dominant_turns' WHEN alternation_ratio < 0.55 THEN 'low_turn_alternation' ELSE 'high_overlap' END AS reason,
    round(CASE speaker_count WHEN 2 THEN 0.6::DOUBLE WHEN 1 THEN 0.15::DOUBLE ELSE greatest(0.0::DOUBLE, 0.45::DOUBLE - 0.15::DOUBLE * greatest(speaker_count - 2, 0)) END + top_two_coverage + alternation_ratio - low_mass_coverage - overlap_ratio, 4) AS dialog_score
  FROM {name}_l
)"""


_PROFILE = f"WITH {SEGMENTS}, pos AS (SELECT * FROM seg WHERE end_ms > start_ms), {_profile('m', 'pos')}"
_UNION = """up AS (
  SELECT *, max(end_ms) OVER (PARTITION BY recording_id, speaker ORDER BY start_ms, end_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM seg WHERE end_ms > start_ms
), ui AS (
  SELECT *, sum((pe IS NULL OR start_ms > pe)::INT) OVER (PARTITION BY recording_id, speaker ORDER BY start_ms, end_ms, seq ROWS UNBOUNDED PRECEDING) AS k FROM up
), u AS (
  SELECT recording_id, speaker, k, min(start_ms) AS s, max(end_ms) AS e FROM ui GROUP BY 1, 2, 3
)"""
_RUNS = """rn AS (
  SELECT recording_id, speaker, run, count(*) AS n FROM (
    SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker, seq ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, (lag(speaker) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker, seq) IS DISTINCT FROM speaker)::INT AS ch FROM seg)) GROUP BY 1, 2, 3
), mr AS (
  SELECT recording_id, speaker, max(n) AS max_run FROM rn GROUP BY 1, 2
)"""
_SNIPPETS = f"""WITH {SEGMENTS}, {_UNION}, b AS (
  SELECT *, greatest(0, start_ms - 250) AS bs, greatest(0, start_ms - 250, end_ms + 250) AS be FROM seg
), c AS (
  SELECT *, CASE WHEN be - bs > 8000 THEN greatest(0, (start_ms + end_ms) // 2 - 4000) ELSE bs END AS cs FROM b
), c0 AS (
  SELECT recording_id, speaker, seq, start_ms, end_ms, cs, CASE WHEN be - bs > 8000 THEN cs + 8000 ELSE be END AS ce FROM c
), ow AS (
  SELECT p.recording_id, p.speaker, s, e, max(e) OVER (PARTITION BY p.recording_id, p.speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
  FROM (SELECT DISTINCT recording_id, speaker FROM seg) p JOIN u ON u.recording_id = p.recording_id AND u.speaker <> p.speaker
), oi AS (
  SELECT *, sum((pe IS NULL OR s > pe)::INT) OVER (PARTITION BY recording_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM ow
), ot AS (
  SELECT recording_id, speaker, min(s) AS s, max(e) AS e FROM oi GROUP BY recording_id, speaker, k
), cl AS (
  SELECT c0.recording_id, c0.speaker, seq, start_ms, end_ms, coalesce(x.e, cs) AS cs, greatest(coalesce(x.e, cs), coalesce(y.s, ce)) AS ce
  FROM c0 LEFT JOIN ot x ON x.recording_id = c0.recording_id AND x.speaker = c0.speaker AND x.s <= cs AND cs < x.e
    LEFT JOIN ot y ON y.recording_id = c0.recording_id AND y.speaker = c0.speaker AND y.s < ce AND ce <= y.e
), ov AS (
  SELECT cl.recording_id, cl.seq, greatest(cs, s) AS s, least(ce, e) AS e FROM cl JOIN u ON cl.recording_id = u.recording_id AND cl.speaker <> u.speaker AND s < ce AND e > cs
), ov2 AS (
  SELECT *, max(e) OVER (PARTITION BY seq ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ov
), oo AS (
  SELECT seq, sum(greatest(0, e - greatest(s, coalesce(pe, s))))::BIGINT AS overlap_ms FROM ov2 GROUP BY 1
), r AS (
  SELECT cl.*, coalesce(overlap_ms, 0) AS overlap_ms, greatest(0, ce - cs) AS duration_ms FROM cl LEFT JOIN oo USING (seq)
), r2 AS (
  SELECT *, CASE WHEN duration_ms > 0 THEN ((overlap_ms * 20000 + duration_ms) // (2 * duration_ms)) / 10000::DOUBLE ELSE 1.0 END AS overlap_ratio FROM r
), r3 AS (
  SELECT *, (((10000 - round(least(overlap_ratio, 1.0) * 10000)::BIGINT) * 136000 + least(duration_ms, 8000) * 30000) * 2 + 160000) // 320000 / 10000::DOUBLE AS purity_score,
    CASE WHEN duration_ms < 800 THEN 'rejected_short' WHEN overlap_ms > 50 OR overlap_ratio > 0.02 THEN 'rejected_overlap' END AS rejected FROM r2
), r4 AS (
  SELECT *, row_number() OVER w AS position, count(*) FILTER (rejected IS NULL) OVER (w ROWS UNBOUNDED PRECEDING) AS usable FROM r3
  WINDOW w AS (PARTITION BY recording_id, speaker ORDER BY purity_score DESC, overlap_ratio, duration_ms DESC, start_ms, end_ms, seq)
), sn AS (
  SELECT recording_id, speaker, seq, cs AS clip_start_ms, ce AS clip_end_ms, duration_ms, overlap_ms, overlap_ratio, purity_score, position,
    coalesce(rejected, CASE WHEN usable > 3 THEN 'rejected_rank_limit' ELSE 'accepted' END) AS status, rejected IS NULL AND usable = 1 AS recommended FROM r4
)"""

QUERIES = {
    "diar_profile_metrics": (diar_profile_metrics, f"{_PROFILE} SELECT * FROM m"),
    "diar_profile_class": (diar_profile_class, f"{_PROFILE} SELECT recording_id, profile, reason, dialog_score FROM m_c"),
    "diar_retry_choice": (
        diar_retry_choice,
        f"""{_PROFILE}, pos2 AS (SELECT * FROM pos WHERE end_ms - start_ms >= 60000), {_profile('n', 'pos2')}, x AS (
  SELECT a.recording_id, a.dialog_score AS initial_score, b.dialog_score AS retry_score, CASE WHEN b.profile <> 'dialog' THEN 'dialog_retry_not_dialog_like' WHEN b.speaker_count < 2 THEN 'dialog_retry_single_speaker'
    WHEN b.dominant_turns < 2 THEN 'dialog_retry_pathological_turns' WHEN b.top_two_coverage < 0.75 THEN 'dialog_retry_low_top_two_coverage'
    WHEN b.dialog_score <= a.dialog_score + 0.05 THEN 'dialog_retry_not_better' ELSE 'dialog_retry_improved_dialog_score' END AS winner_reason FROM m_c a JOIN n_c b USING (recording_id)
) SELECT *, CASE WHEN winner_reason = 'dialog_retry_improved_dialog_score' THEN 'dialog_retry' ELSE 'initial_pass' END AS selected_result FROM x""",
    ),
    "speaker_max_runs": (speaker_max_runs, f"WITH {SEGMENTS}, {_RUNS} SELECT * FROM mr"),
    "flicker_relabel": (
        flicker_relabel,
        f"""WITH {SEGMENTS}, {_TOTALS}, {_RUNS}, fl AS (
  SELECT s.*, total_ms < 3200000 AND max_run <= 3 AS flicker FROM seg s JOIN tot USING (recording_id, speaker) JOIN mr USING (recording_id, speaker)
), near AS (
  SELECT f.recording_id, f.seq, s.speaker, row_number() OVER (PARTITION BY f.recording_id, f.seq ORDER BY greatest(0, s.start_ms - f.end_ms, f.start_ms - s.end_ms), s.start_ms, s.end_ms, s.speaker, s.seq) AS r
  FROM fl f JOIN fl s ON f.recording_id = s.recording_id WHERE f.flicker AND NOT s.flicker
) SELECT fl.recording_id, fl.seq, coalesce(near.speaker, fl.speaker) AS speaker, flicker FROM fl LEFT JOIN near ON fl.recording_id = near.recording_id AND fl.seq = near.seq AND r = 1""",
    ),
    "speakers_overlap_any": (
        speakers_overlap_any,
        f"""WITH {SEGMENTS} SELECT DISTINCT a.recording_id, a.speaker AS speaker_a, b.speaker AS speaker_b FROM seg a JOIN seg b ON a.recording_id = b.recording_id AND a.speaker < b.speaker
  AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 100""",
    ),
    "speaker_overlap_ratio": (
        speaker_overlap_ratio,
        f"""WITH {SEGMENTS}, {_UNION}, t AS (SELECT recording_id, speaker, sum(e - s) AS total FROM u GROUP BY 1, 2), o AS (
  SELECT a.recording_id, a.speaker AS speaker_a, b.speaker AS speaker_b, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS overlap_ms FROM u a JOIN u b ON a.recording_id = b.recording_id AND a.speaker < b.speaker AND a.s < b.e AND b.s < a.e GROUP BY 1, 2, 3
) SELECT o.*, round(overlap_ms / least(x.total, y.total)::DOUBLE, 4) AS overlap_ratio FROM o JOIN t x ON x.recording_id = o.recording_id AND x.speaker = speaker_a JOIN t y ON y.recording_id = o.recording_id AND y.speaker = speaker_b""",
    ),
    "snippet_rank": (snippet_rank, f"{_SNIPPETS} SELECT * FROM sn"),
    "snippet_counts": (
        snippet_counts,
        f"{_SNIPPETS} SELECT recording_id, sum(a)::BIGINT AS accepted, sum(n)::BIGINT AS snippets, count(*) FILTER (a = 0) AS speakers_without FROM (SELECT recording_id, speaker, count(*) FILTER (status = 'accepted') AS a, count(*) AS n FROM sn GROUP BY 1, 2) GROUP BY 1",
    ),
    "speaker_merge_greedy": (speaker_merge_greedy, None),
}
