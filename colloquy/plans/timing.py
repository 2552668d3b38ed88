"""Queries over calendar matching and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import calendar, language
from colloquy.plans.sql import MS
from colloquy.sources.tables import calendar_events, captures, conversation_turns, table


def calendar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each recording: how many, how many with a score, and the best one."""
    return calendar.summaries(captures(spark, sf_dir), calendar_events(spark, sf_dir))


def calendar_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.decisions(captures(spark, sf_dir), calendar_events(spark, sf_dir))


def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[c.alias(n) for n, c in language.guess(F.col("text")).items()])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_turns(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    details = language.segment_language(nothing, nothing, nothing.cast("double"), nothing, F.col("text"))
    return rows.select("recording_id", "seq", "start_ms", "end_ms", "text", *[c.alias(n) for n, c in details.items()])


def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.distribution(_turns(spark, sf_dir))


def language_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.dominant(language.distribution(_turns(spark, sf_dir)))


def language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.spans(_turns(spark, sf_dir))


def language_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.needs_review(_turns(spark, sf_dir))


def language_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.chunk_plan(_turns(spark, sf_dir))


def language_multilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    return language.multilingual(language.distribution(rows), language.spans(rows))


_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)
_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z\\x{00c0}-\\x{017f}]+')"


def _guess(source: str, key: str) -> str:
    return f"""tk AS (SELECT *, {_TOKENS} AS tk FROM {source}), gs AS (
  SELECT *, len(list_filter(tk, lambda t: t IN ({_IN(language.ENGLISH)}))) AS en_score,
    len(list_filter(tk, lambda t: t IN ({_IN(language.SPANISH)}))) + CASE WHEN len(tk) > 0 AND regexp_matches(lower(coalesce(text, '')), '[áéíóúñ¿¡]') THEN 2 ELSE 0 END AS es_score FROM tk
), g AS (
  SELECT *, CASE WHEN en_score > es_score THEN 'en' WHEN es_score > en_score THEN 'es' END AS lead, CASE WHEN en_score + es_score > 0 THEN round(greatest(en_score, es_score) / (en_score + es_score)::DOUBLE, 4) END AS share FROM gs
)"""


_CAPTURES = f"""rec AS (SELECT event_id AS recording_id, {MS} AS captured, value AS sec FROM events WHERE event_type = 'purchase'),
ev AS (SELECT 'e' || event_id AS event_id, {MS} AS s, {MS} + round(value * 20000)::BIGINT AS e FROM events WHERE event_type = 'signup'), pr AS (
  SELECT *, greatest(0.0, 1.0 - abs(captured - s) / 60000::DOUBLE / 180.0) AS near, CASE WHEN captured BETWEEN s AND e THEN 1.0 WHEN s > captured AND s - captured <= 900000 THEN greatest(0.45, 0.9 - (s - captured) / 60000::DOUBLE / 30.0) ELSE 0.0 END AS there,
    greatest((e - s) / 1000::DOUBLE, 60.0) AS event, greatest(0.0, (least(captured + sec * 1000, e) - greatest(captured, s)) / 1000::DOUBLE) AS shared
  FROM rec JOIN ev ON e > s AND s < greatest(captured + 43200000, captured + (sec * 1000)::BIGINT + 7200000) AND e > captured - 28800000
), q AS (
  SELECT *, least(1.0, shared / greatest(sec, 1.0)) AS orec, least(1.0, shared / greatest(event, 1.0)) AS oev, greatest(0.0, 1.0 - abs(event - sec) / greatest(event, sec, 1.0)) AS alike FROM pr
), sc AS (
  SELECT recording_id, event_id, s AS starts_ms, round(greatest(0.0, least(0.24 * near + 0.18 * there + 0.30 * (0.45 * orec + 0.55 * oev) + 0.18 * CASE WHEN shared <= 0 THEN 0.0 ELSE alike * (0.35 + 0.65 * oev) END, 1.0)), 4) AS score FROM q
)"""
_TURNS = f"""conv AS (
  SELECT conv_id::VARCHAR AS recording_id, turn AS seq, text, (sum(length(coalesce(text, '')) * 60) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS end_ms, length(coalesce(text, '')) * 60 AS n FROM conversations
), {_guess('conv', 'seq')}, turns AS (
  SELECT recording_id, seq, end_ms - n AS start_ms, end_ms, text, coalesce(lead, 'unknown') AS language, CASE WHEN lead IS NOT NULL THEN share END AS conf, lead IS NULL OR share < 0.75 AS uncertain, FALSE AS conflict FROM g
), dist AS (
  SELECT recording_id, language, sum(CASE WHEN end_ms > start_ms THEN end_ms - start_ms ELSE 10 END)::BIGINT AS weight FROM turns GROUP BY 1, 2
), shares AS (
  SELECT *, round(weight * 100 / (sum(weight) OVER (PARTITION BY recording_id))::DOUBLE, 2) AS percent FROM dist
)"""


def _stretches(gap: int, same: str) -> str:
    o = "PARTITION BY recording_id ORDER BY start_ms, end_ms, seq"
    return f"""c1 AS (SELECT *, ({same} IS DISTINCT FROM lag({same}) OVER ({o}))::INT AS ch FROM turns), c2 AS (SELECT *, sum(ch) OVER ({o} ROWS UNBOUNDED PRECEDING) AS run FROM c1), c3 AS (
  SELECT *, max(end_ms) OVER (PARTITION BY recording_id, run ORDER BY start_ms, end_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM c2
), c4 AS (SELECT *, sum((pe IS NULL OR start_ms > pe + {gap})::INT) OVER ({o} ROWS UNBOUNDED PRECEDING) AS island FROM c3), st AS (
  SELECT recording_id, any_value(language) AS language, bool_or(uncertain) AS uncertain, bool_or(conflict) AS conflict, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS segments FROM c4 GROUP BY recording_id, island
)"""


QUERIES = {
    "calendar_candidates": (calendar_candidates, f"WITH {_CAPTURES} SELECT recording_id, count(*) AS candidates, count(*) FILTER (score > 0) AS scored, max(score) AS top_score FROM sc GROUP BY 1"),
    "calendar_decision": (
        calendar_decision,
        f"""WITH {_CAPTURES}, rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, starts_ms, event_id) AS r, count(*) OVER (PARTITION BY recording_id) AS n FROM sc), d AS (
  SELECT rec.recording_id, coalesce(a.n, 0) AS candidates, a.event_id AS top_event_id, a.score AS top_score, round(a.score - b.score, 4) AS margin_to_next FROM rec LEFT JOIN rk a ON a.recording_id = rec.recording_id AND a.r = 1 LEFT JOIN rk b ON b.recording_id = rec.recording_id AND b.r = 2
), x AS (SELECT *, CASE WHEN candidates = 0 THEN 'no_candidates' WHEN top_score < 0.74 THEN 'below_threshold' WHEN margin_to_next < 0.10 THEN 'margin_too_small' ELSE 'selected' END AS reason FROM d)
SELECT *, CASE WHEN reason = 'selected' THEN top_event_id END AS selected_event_id FROM x""",
    ),
    "language_guess": (language_guess, f"WITH {_guess('documents', 'doc_id')} SELECT doc_id, en_score, es_score, lead AS language, share AS confidence FROM g"),
    "language_distribution": (language_distribution, f"WITH {_TURNS} SELECT * FROM shares"),
    "language_dominant": (
        language_dominant,
        f"WITH {_TURNS} SELECT recording_id, first(language ORDER BY language = 'unknown', weight DESC, language) AS dominant_language, count(*) FILTER (language <> 'unknown') AS languages FROM shares GROUP BY 1",
    ),
    "language_spans": (language_spans, f"WITH {_TURNS}, {_stretches(500, 'language')} SELECT recording_id, language, start_ms, end_ms, segments FROM st"),
    "language_review": (
        language_review,
        f"WITH {_TURNS}, s AS (SELECT recording_id, count(*) FILTER (uncertain) AS uncertain, 0::BIGINT AS conflicts, count(DISTINCT language) FILTER (language <> 'unknown') AS languages FROM turns GROUP BY 1) SELECT *, languages >= 2 AND uncertain >= 2 AS review FROM s",
    ),
    "language_chunks": (language_chunks, f"WITH {_TURNS}, {_stretches(750, '(language, uncertain)')} SELECT * FROM st"),
    "language_multilingual": (
        language_multilingual,
        f"""WITH {_TURNS}, {_stretches(500, 'language')}, a AS (SELECT recording_id, count(*) FILTER (percent >= 15) AS c FROM shares WHERE language <> 'unknown' GROUP BY 1), b AS (
  SELECT recording_id, count(DISTINCT language) AS l FROM st WHERE language <> 'unknown' AND end_ms - start_ms >= 3000 GROUP BY 1) SELECT recording_id, c >= 2 AND coalesce(l, 0) >= 2 AS multilingual FROM a LEFT JOIN b USING (recording_id)""",
    ),
}
