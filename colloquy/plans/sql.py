"""SQL of the views in ``sources.tables``, for the SQL forms of queries."""

MS = "epoch_us(ts) // 1000"
SEGMENTS = f"""seg AS (
  SELECT strftime(ts, '%Y-%m-%d') AS recording_id, event_id AS seq, 'S' || (user_id % 5) AS speaker, {MS} AS start_ms,
    {MS} + round(value * 1000)::BIGINT AS end_ms, event_type AS text FROM events
)"""
BLOCKS = """runs AS (
  SELECT *, sum(change) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker, seq ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, (speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker, seq))::INT AS change FROM seg)
), brk AS (
  SELECT *, max(end_ms) OVER (PARTITION BY recording_id, run ORDER BY start_ms, end_ms, speaker, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM runs
), blk AS (
  SELECT *, sum((prev_end IS NULL OR start_ms > prev_end + 60000)::INT) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms, speaker, seq ROWS UNBOUNDED PRECEDING) AS island FROM brk
), blocks AS (
  SELECT recording_id, island, any_value(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_turns FROM blk GROUP BY 1, 2
)"""
INTERRUPTIONS = """hits AS (
  SELECT DISTINCT t.recording_id, t.seq, t.speaker, p.speaker AS interrupted FROM seg p JOIN seg t ON p.recording_id = t.recording_id AND p.speaker <> t.speaker
    AND p.start_ms < t.start_ms AND t.start_ms < p.end_ms AND least(p.end_ms, t.end_ms) - t.start_ms >= 300
), ints AS (
  SELECT recording_id, speaker, sum(done)::BIGINT AS interruptions_done, sum(received)::BIGINT AS interruptions_received FROM (
    SELECT recording_id, speaker, 1 AS done, 0 AS received FROM hits UNION ALL SELECT recording_id, interrupted, 0, 1 FROM hits
    UNION ALL SELECT DISTINCT recording_id, speaker, 0, 0 FROM seg) GROUP BY 1, 2
)"""
